"""Keyed lookups, semi- and anti-joins of governance tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.validators import requires_encryption

#: Tables of rules up to so many bytes are broadcast; larger ones are joined by shuffle.
BROADCAST_BYTES = 32 << 20


class NotFound(LookupError):
    """A keyed lookup found no row."""


def small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if its bytes, measured as text, are few."""
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def by_id(df: DataFrame, column: str, value) -> DataFrame:
    found = df.filter(F.col(column) == F.lit(value))
    if found.isEmpty():
        raise NotFound(f"{column} = {value!r}")
    return found


def field_rules(fields: DataFrame, rules: DataFrame, field: str = "field_name", default_class: int = 0, default_sensitivity: int = 0) -> DataFrame:
    """Fields with their rule; a field without one is public and neutral."""
    joined = fields.join(small(rules.withColumnRenamed(field, "rule_field_")), F.col(field) == F.col("rule_field_"), "left").drop("rule_field_")
    return joined.withColumns({"classification": F.coalesce("classification", F.lit(default_class)), "sensitivity": F.coalesce("sensitivity", F.lit(default_sensitivity))})


def remaining_steps(steps: DataFrame, done: DataFrame, order: list[str]) -> DataFrame:
    return steps.join(done, "step_id", "left_anti").orderBy(*order)


def checked_steps(records: DataFrame, steps: DataFrame) -> DataFrame:
    """Completed steps of the playbook with status: UNKNOWN_STEP, BAD_TIMES, or whether the allowed time was kept."""
    joined = records.join(small(steps.select("step_id", "sla_seconds")), "step_id", "left")
    elapsed = F.floor((F.col("completed_at_ns") - F.col("started_at_ns")) / F.lit(1_000_000_000))
    status = F.when(F.col("sla_seconds").isNull(), "UNKNOWN_STEP").when(F.col("completed_at_ns") < F.col("started_at_ns"), "BAD_TIMES").when((F.col("sla_seconds") == 0) | (elapsed <= F.col("sla_seconds")), "MET").otherwise("BREACHED")
    return joined.withColumn("status", status).withColumn("sla_met", F.col("status") == "MET")


def policy_violations(columns: DataFrame, encrypted: DataFrame) -> DataFrame:
    """Personal and sensitive columns without a key."""
    return columns.filter(requires_encryption(F.col("classification"))).join(encrypted, "column_name", "left_anti")


def all_complete(steps: DataFrame, done: DataFrame, strict: bool = True) -> DataFrame:
    """One row (complete): every step is done; not strict, the numbers of rows are equal."""
    if strict:
        return steps.join(done, "step_id", "left_anti").agg((F.count("*") == 0).alias("complete"))
    both = steps.select(F.lit(1).alias("s"), F.lit(0).alias("d")).unionByName(done.select(F.lit(0).alias("s"), F.lit(1).alias("d")))
    return both.agg((F.coalesce(F.sum("s"), F.lit(0)) == F.coalesce(F.sum("d"), F.lit(0))).alias("complete"))


def correlated(decisions: DataFrame, inferences: DataFrame, verify: bool = True) -> DataFrame:
    """One row over both logs' aggregates; with verification their chain ids must agree where both have one."""
    a = decisions.agg(F.count("*").alias("decisions"), F.max("chain_id").alias("chain_a")).withColumn("k_", F.lit(1))
    b = inferences.agg(F.count("*").alias("inferences"), F.max("chain_id").alias("chain_b")).withColumn("k_", F.lit(1))
    out = a.join(b, "k_").drop("k_")
    return out.withColumn("chains_agree", F.lit(not verify) | F.col("chain_a").isNull() | F.col("chain_b").isNull() | (F.col("chain_a") == F.col("chain_b")))


def latest_change(changes: DataFrame, key: str, order: str) -> DataFrame:
    top = Window.partitionBy(key).orderBy(F.col(order).desc())
    return changes.withColumn("n_", F.row_number().over(top)).filter("n_ = 1").drop("n_")
