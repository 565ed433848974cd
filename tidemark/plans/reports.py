"""Compliance reports over decision and inference logs: rows as columns, text lines, and assembled documents."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import csv_field, iso8601, json_text, label_of, significant
from ..operators.scan import in_range

#: Codes and their report labels: fixed values.
DECISION_TYPES = {0: "SIGNAL", 1: "ORDER_NEW", 2: "ORDER_CANCEL", 3: "ORDER_MODIFY", 4: "POSITION_OPEN", 5: "POSITION_CLOSE", 6: "RISK_OVERRIDE", 7: "NO_ACTION"}
RISK_RESULTS = {0: "PASSED", 1: "REJECTED", 2: "MODIFIED", 3: "THROTTLED"}
BUY_SELL = {0: "BUYI", 1: "SELL", 2: "SSEX"}
ORDER_TYPES = {0: "MARKET", 1: "LIMIT", 2: "STOP", 3: "STOP_LIMIT", 4: "PEGGED", 99: "OTHER"}
TIMES_IN_FORCE = {0: "DAY", 1: "GTC", 2: "IOC", 3: "FOK", 4: "GTD", 99: "OTHER"}
CSV_HEADER = "timestamp_utc,order_id,firm_id,algo_identifier,model_version,instrument,venue,decision_type,price,quantity,risk_gate,model_output,confidence,buy_sell,order_type,time_in_force,isin,currency,short_selling,aggregated_order,parent_order_id,chain_seq,chain_hash"


def reported(decisions: DataFrame, start_ns: int | None = None, end_ns: int | None = None) -> DataFrame:
    """Decisions of the period, both ends included."""
    return decisions.filter(in_range(F.col("timestamp_ns"), start_ns, end_ns))


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _flag(name: str) -> Column:
    return F.when(F.coalesce(F.col(name), F.lit(False)), F.lit("true")).otherwise(F.lit("false"))


def csv_lines(decisions: DataFrame, firm_id: str = "", digits: int = 9, price_digits: int = 10) -> Column:
    algo = F.col("strategy_id").cast("string")
    fields = [
        iso8601(F.col("timestamp_ns"), digits), csv_field(_text("order_id")), csv_field(F.lit(firm_id)) if firm_id else algo, algo, csv_field(_text("model_version")), csv_field(_text("symbol")), csv_field(_text("venue")),
        label_of(F.col("decision_type"), DECISION_TYPES), significant(F.col("price"), price_digits), significant(F.col("quantity")), label_of(F.col("risk_result"), RISK_RESULTS),
        significant(F.col("model_output")), significant(F.col("confidence")), label_of(F.col("buy_sell"), BUY_SELL), label_of(F.col("order_type"), ORDER_TYPES), label_of(F.col("time_in_force"), TIMES_IN_FORCE),
        csv_field(_text("isin")), csv_field(_text("currency")), _flag("short_selling_flag"), _flag("aggregated_order"), csv_field(_text("parent_order_id")), F.lit(""), F.lit(""),
    ]
    return F.concat_ws(",", *fields)


def json_lines(digits: int = 9, price_digits: int = 10) -> Column:
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    pairs = [
        ("ts", quoted(iso8601(F.col("timestamp_ns"), digits))), ("order_id", quoted(json_text(_text("order_id")))), ("algo", quoted(F.col("strategy_id").cast("string"))), ("model", quoted(json_text(_text("model_version")))),
        ("instrument", quoted(json_text(_text("symbol")))), ("venue", quoted(json_text(_text("venue")))), ("type", quoted(label_of(F.col("decision_type"), DECISION_TYPES))), ("price", significant(F.col("price"), price_digits)),
        ("qty", significant(F.col("quantity"))), ("risk_gate", quoted(label_of(F.col("risk_result"), RISK_RESULTS))), ("output", significant(F.col("model_output"))), ("conf", significant(F.col("confidence"))),
        ("buy_sell", quoted(label_of(F.col("buy_sell"), BUY_SELL))), ("order_type", quoted(label_of(F.col("order_type"), ORDER_TYPES))), ("tif", quoted(label_of(F.col("time_in_force"), TIMES_IN_FORCE))),
        ("isin", quoted(json_text(_text("isin")))), ("ccy", quoted(json_text(_text("currency")))), ("short_sell", _flag("short_selling_flag")), ("aggregated", _flag("aggregated_order")),
    ]
    parts = [F.concat(F.lit(f'"{k}":'), v) for k, v in pairs]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def json_document(decisions: DataFrame, report_id: str, firm_id: str = "", start_ns: int | None = None, end_ns: int | None = None, digits: int = 9, price_digits: int = 10) -> DataFrame:
    """The lines (place, line) of one JSON document: an envelope with the report's fields and its records in an array.

    Records are lines of their own, so the document is written by all tasks in order and never held by one. Lines are
    numbered along a sort by range; the commas stand before the records.
    """
    from ..operators.aggregates import with_rank

    rows = reported(decisions, start_ns, end_ns)
    order = [c for c in ("timestamp_ns", "chain_seq") if c in decisions.columns]
    placed = with_rank(rows.select(F.struct(*order).alias("k"), json_lines(digits, price_digits).alias("line")), "k")
    head = json.dumps({"report_type": "MIFID_II_TRANSACTION", "report_id": report_id, "firm_id": firm_id}, ensure_ascii=False)[:-1] + ', "records": ['
    records = placed.select(F.col("rank").alias("place"), F.concat(F.when(F.col("rank") > 1, F.lit(",")).otherwise(F.lit("")), F.col("line")).alias("line"))
    ends = decisions.sparkSession.createDataFrame([(0, head), ((1 << 62), "]}")], "place long, line string")
    return ends.filter("place = 0").unionByName(records).unionByName(ends.filter("place > 0")).orderBy("place")


def transaction_report(decisions: DataFrame, form: str, start_ns: int | None = None, end_ns: int | None = None, firm_id: str = "", digits: int = 9, price_digits: int = 10) -> DataFrame:
    """One row a record in report order (timestamp_ns, chain_seq, line); ``form`` is csv or ndjson."""
    line = csv_lines(decisions, firm_id, digits, price_digits) if form == "csv" else json_lines(digits, price_digits)
    order = [c for c in ("timestamp_ns", "chain_seq") if c in decisions.columns]
    # sorted first: the sort's sample and its shuffle then see plain columns, and lines are made by all tasks after it
    return reported(decisions, start_ns, end_ns).orderBy(*order).select(*order, line.alias("line"))


def write_report(lines: DataFrame, path: str, header: str | None = CSV_HEADER) -> None:
    """Report lines as text files in order; the header is a file of its own that sorts first."""
    lines.select("line").write.mode("overwrite").text(f"{path}/part=1")
    if header is not None:
        lines.sparkSession.createDataFrame([(header,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/part=0")


def record_keeping(decisions: DataFrame, inferences: DataFrame, start_ns: int | None = None, end_ns: int | None = None) -> DataFrame:
    """One row: what automatic logging must show of a period."""
    d = reported(decisions, start_ns, end_ns).agg(
        F.count("*").alias("decisions"), F.count_if(F.col("decision_type") == 1).alias("orders_new"), F.count_if(F.col("risk_result") == 1).alias("rejected"), F.count_if(F.col("decision_type") == 6).alias("overrides"),
        F.min("timestamp_ns").alias("first_ns"), F.max("timestamp_ns").alias("last_ns"),
    )
    i = reported(inferences, start_ns, end_ns).agg(F.count("*").alias("inferences"), F.avg("latency_ns").cast("long").alias("avg_latency_ns"), F.avg("output_score").alias("avg_score"), F.countDistinct("model_version").alias("model_versions"))
    return d.withColumn("k_", F.lit(1)).join(i.withColumn("k_", F.lit(1)), "k_").drop("k_")


def report_json(summary: DataFrame, report_type: str, report_id: str) -> str:
    """A one-row summary as a JSON document, on the driver."""
    row = summary.first().asDict(recursive=True)
    return json.dumps({"report_type": report_type, "report_id": report_id, **row}, sort_keys=False, default=str)


def transparency(inferences: DataFrame, start_ns: int | None = None, end_ns: int | None = None, low: float = 0.5) -> DataFrame:
    """One row: how a system behaved in a period: volume, scores, latency, low confidence, tokens, kinds of inference."""
    rows = reported(inferences, start_ns, end_ns)
    kind = F.col("inference_type")
    return rows.agg(
        F.count("*").alias("inferences"), F.avg("output_score").alias("avg_score"), F.avg("latency_ns").cast("long").alias("avg_latency_ns"), F.count_if(F.col("output_score") < low).alias("low_confidence"),
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("batch_size").alias("batch_total"), *[F.count_if(kind == t).alias(f"type_{t}") for t in range(8)],
    )


def conformity(decisions: DataFrame, inferences: DataFrame, start_ns: int | None = None, end_ns: int | None = None, verify: bool = True) -> DataFrame:
    """One row over both logs of a period, with chain agreement and anomalies (latency over mean + 3 deviations)."""
    from ..operators.aggregates import anomalies
    from ..operators.lookups import correlated

    d, i = reported(decisions, start_ns, end_ns), reported(inferences, start_ns, end_ns)
    over = anomalies(i, "latency_ns").agg(F.count("*").alias("anomalies"), F.lit(1).alias("k_"))
    return correlated(d, i, verify).withColumn("k_", F.lit(1)).join(over, "k_").drop("k_")
