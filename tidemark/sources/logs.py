"""Decision, inference and override logs: schemas, readers, chained writers, feature files, stream files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.codecs import record_bytes
from ..operators import chain
from ..operators.scan import SchemaMismatch

DECISION = "timestamp_ns long, strategy_id int, model_version string, decision_type int, input_features array<float>, model_output double, confidence double, risk_result int, order_id string, symbol string, price double, quantity double, venue string, notes string"
DECISION_ORDER = "buy_sell int, order_type int, time_in_force int, isin string, currency string, short_selling_flag boolean, aggregated_order boolean, validity_period_ns long, parent_order_id string"
INFERENCE = "timestamp_ns long, model_id string, model_version string, inference_type int, input_embedding array<float>, input_hash string, output_hash string, output_score double, latency_ns long, batch_size int, input_tokens int, output_tokens int, user_id_hash string, session_id string, metadata_json string"
INFERENCE_TRAINING = "training_dataset_id string, training_dataset_size long, training_data_characteristics string, training_end_ns long, knowledge_cutoff_ns long, training_schedule string"
OVERRIDE = "timestamp_ns long, operator_id string, operator_role string, source int, action int, system_id string, original_decision_id string, original_output string, original_confidence double, override_output string, rationale string, urgency int"
FILE_ROWS = 1_000_000


def schema(*parts: str) -> T.StructType:
    return T.StructType.fromDDL(", ".join(parts))


def clamped(col: Column, low: int, high: int) -> Column:
    """Codes outside their range read as the first."""
    return F.when(col.between(low, high), col).otherwise(F.lit(0))


def read_decisions(spark: SparkSession, *paths: str) -> DataFrame:
    df = spark.read.parquet(*paths)
    return df.withColumns({"decision_type": clamped(F.col("decision_type"), 0, 7), "risk_result": clamped(F.col("risk_result"), 0, 3)})


def read_inferences(spark: SparkSession, *paths: str) -> DataFrame:
    df = spark.read.parquet(*paths)
    kind = F.col("inference_type")
    return df.withColumn("inference_type", F.when(kind.between(0, 6) | (kind == 255), kind).otherwise(F.lit(0)))


def read_overrides(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def serialized(df: DataFrame) -> Column:
    """Deterministic bytes of all columns of a record, in column order by kind."""
    longs, doubles, texts = [], [], []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.LongType, T.IntegerType, T.BooleanType)):
            longs.append(F.col(f.name))
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            doubles.append(F.col(f.name))
        else:
            texts.append(F.to_json(f.name) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(f.name))
    return record_bytes(longs, doubles, texts)


def chained(df: DataFrame, chain_id: str, order: list[str], origin: str = "") -> DataFrame:
    """Records with their chain and lineage columns. A time of 0 becomes the current time before hashing, so it verifies."""
    now = F.unix_micros(F.current_timestamp()) * 1000
    timed = df.withColumn("timestamp_ns", F.when(F.col("timestamp_ns") == 0, now).otherwise(F.col("timestamp_ns")))
    with_bytes = timed.withColumn("record_", serialized(timed.drop(chain_id)))
    linked = chain.create(with_bytes, chain_id, order, "timestamp_ns", "record_")
    return chain.lineage(linked, chain_id, order, "record_", origin).drop("record_")


def write_log(df: DataFrame, path: str, chain_id: str, order: list[str], valid: Column | None = None) -> None:
    """Appends chained records; a validity column refuses the whole batch if a record fails it."""
    if valid is not None and not df.filter(~F.coalesce(valid, F.lit(False))).isEmpty():
        raise ValueError("a record does not pass its validator")
    chained(df, chain_id, order, path).write.mode("append").option("maxRecordsPerFile", FILE_ROWS).parquet(path)


def write_features(df: DataFrame, path: str, feature_names: list[str]) -> None:
    """Appends feature rows: entity, time, version, and exactly the named features, as doubles; optional provenance is kept."""
    provenance = [c for c in ("computation_dag", "source_row_ids") if c in df.columns]
    wanted = ["entity_id", "timestamp_ns", "version", *feature_names, *provenance]
    if set(wanted) != set(df.columns):
        raise SchemaMismatch(f"expected columns {wanted}, got {df.columns}")
    out = df.select("entity_id", "timestamp_ns", "version", *[F.col(c).cast("double").alias(c) for c in feature_names], *provenance)
    out.write.mode("append").option("maxRecordsPerFile", FILE_ROWS).parquet(path)


def hybrid_read(spark: SparkSession, closed: str | DataFrame, live: DataFrame | None = None, start_ns: int | None = None, end_ns: int | None = None, type_id: int = 0, max_rows: int | None = None) -> DataFrame:
    """Stream records of closed files and, where given, live rows: (timestamp_ns, type_id, payload), filters always applied."""
    old = closed if isinstance(closed, DataFrame) else spark.read.option("ignoreMissingFiles", True).option("ignoreCorruptFiles", True).schema("timestamp_ns long, type_id int, payload string").parquet(closed)
    rows = old.unionByName(live) if live is not None else old
    if start_ns is not None:
        rows = rows.filter(F.col("timestamp_ns") >= start_ns)
    if end_ns is not None:
        rows = rows.filter(F.col("timestamp_ns") <= end_ns)
    if type_id:
        rows = rows.filter(F.col("type_id") == type_id)
    out = rows.select("timestamp_ns", "type_id", F.unbase64("payload").alias("payload"))
    return out.orderBy("timestamp_ns", "type_id", "payload").limit(max_rows) if max_rows is not None else out
