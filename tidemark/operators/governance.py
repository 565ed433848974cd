"""Threat models, incidents, regulatory changes, retention."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.validators import dread_composite, dread_severity, dread_valid

#: Numbers of STRIDE categories, and the lowest status that counts as mitigated (accepted and transferred do).
CATEGORIES, MITIGATED = 6, 2
#: Regulatory status: 4 verified, 5 not applicable.
SETTLED = (4, 5)


def worst_status(statuses: Column) -> Column:
    """The lowest status of a list; 0 (not mitigated) for none."""
    return F.coalesce(F.array_min(statuses), F.lit(0))


def threat_summary(threats: DataFrame) -> DataFrame:
    """One row: totals, severities, mitigation, mean score, missing categories. Invalid scores count in the total only."""
    score = dread_composite(F.col("dread"))
    ok = dread_valid(F.col("dread"))
    status = worst_status(F.transform("mitigations", lambda m: m["status"]))
    rows = threats.select(ok.alias("ok"), score.alias("score"), dread_severity(score).alias("severity"), status.alias("status"), F.col("category").alias("category"))
    valid = F.col("ok")
    out = rows.agg(
        F.count("*").alias("total"),
        *[F.count_if(valid & (F.col("severity") == s)).alias(s.lower()) for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW")],
        F.count_if(valid & (F.col("status") >= MITIGATED)).alias("mitigated"),
        F.count_if(valid & (F.col("status") < MITIGATED)).alias("unmitigated"),
        F.coalesce(F.avg(F.when(valid, F.col("score"))), F.lit(0.0)).alias("mean_score"),
        F.collect_set(F.when(valid, F.col("category"))).alias("seen"),
    )
    return out.withColumn("missing_categories", F.array_except(F.sequence(F.lit(0), F.lit(CATEGORIES - 1)), "seen")).drop("seen").withColumn("complete", F.size("missing_categories") == 0)


def sla_breaches(records: DataFrame) -> DataFrame:
    return records.agg(F.count_if(~F.col("sla_met")).alias("breaches"))


def steps_for_phase(steps: DataFrame, phase: int) -> DataFrame:
    return steps.filter(F.col("phase") == phase)


def pending_changes(changes: DataFrame) -> DataFrame:
    return changes.filter(~F.col("status").isin(*SETTLED))


def changes_with_impact(changes: DataFrame, least: int) -> DataFrame:
    return changes.filter(F.col("impact") >= least)


def with_status(changes: DataFrame, change_id: str, status: int, assessor: str | None = None) -> DataFrame:
    hit = F.col("change_id") == change_id
    out = changes.withColumn("status", F.when(hit, F.lit(status)).otherwise(F.col("status")))
    return out.withColumn("assessor", F.when(hit, F.lit(assessor)).otherwise(F.col("assessor"))) if assessor else out


def retention_class(age_ns: Column, max_age_ns: int, archive_after_ns: int, min_retention_ns: int = 0) -> Column:
    """DELETE past the greatest age, ARCHIVE past the archive age, else ACTIVE; nothing goes before its least age."""
    kept = F.lit(min_retention_ns > 0) & (age_ns < min_retention_ns)
    return F.when(kept, "ACTIVE").when(age_ns > max_age_ns, "DELETE").when(age_ns > archive_after_ns, "ARCHIVE").otherwise("ACTIVE")


def retention_plan(files: DataFrame, max_age_ns: int, archive_after_ns: int, min_retention_ns: int = 0, max_active_files: int | None = None) -> DataFrame:
    """Files, oldest first, with their class; of active files beyond the allowed number the oldest are archived."""
    from pyspark.sql import Window

    planned = files.withColumn("retention", retention_class(F.col("age_ns"), max_age_ns, archive_after_ns, min_retention_ns))
    if max_active_files is not None:
        newest = F.row_number().over(Window.partitionBy("retention").orderBy("age_ns", "path"))
        planned = planned.withColumn("retention", F.when((F.col("retention") == "ACTIVE") & (newest > max_active_files), "ARCHIVE").otherwise(F.col("retention")))
    return planned.orderBy(F.col("age_ns").desc(), "path")


def retention_summary(plan: DataFrame) -> DataFrame:
    return plan.groupBy("retention").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))


def enforce(plan: DataFrame, archive: Callable[[str], None], delete: Callable[[str], None], may_delete: Callable[[str], bool] = lambda path: True) -> dict[str, int]:
    """Applies a plan: callbacks archive and delete files, and a veto keeps a file. Rows are streamed, not gathered."""
    done = {"ARCHIVE": 0, "DELETE": 0, "VETOED": 0}
    for row in plan.filter("retention <> 'ACTIVE'").toLocalIterator():
        if row["retention"] == "ARCHIVE":
            archive(row["path"])
        elif may_delete(row["path"]):
            delete(row["path"])
        else:
            done["VETOED"] += 1
            continue
        done[row["retention"]] += 1
    return done
