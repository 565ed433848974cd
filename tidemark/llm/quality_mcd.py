"""Quality rules with robust multivariate outliers; DataFrame expressions only.

Each text gives counts: words, characters in words, symbols, repeated lines, and words in three-word windows that
occur twice or more. Two plain rules come first (too few words, too much repetition). Of the texts that pass, five
transformed statistics per text are compared with the text's own group, its language and source: location and
scatter are minimum-covariance-determinant estimates, found by concentration steps (keep the share ``KEEP`` of the
texts with the smallest Mahalanobis distance, estimate again) from two starts, medians and quartiles, and all texts'
mean and covariance; the scatter with the smaller determinant is taken. A text whose
squared distance from the final estimate exceeds ``CUTOFF`` is rejected.

The share is cut at a bin of a fixed logarithmic histogram of distances, and the start's quantiles at bins of fixed
width, so every step is a grouped sum that combines before the shuffle; a group of any size, a third of all rows too,
never meets in one task, and results do not hang on the order of rows. Scatter is widened by ``FLOOR`` (the spread
that every statistic is granted), so statistics that hardly vary inside a group reject nothing by trifles.

Groups of fewer than ``LEAST`` texts that pass are pooled by language, then all together; if those are too few as
well, the plain rules decide alone. Null languages and sources are groups of their own. Null texts have no words.
Repeated rows get equal results. An empty table gives an empty one. Of the table only id, language, source and text
are read, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import table, written
from .native import let, windows

SPACE = r"[\x20\x09-\x0D]"
LEAST_WORDS, MOST_REPEAT_PERCENT = 50, 50
STATISTICS = ("x0", "x1", "x2", "x3", "x4")
#: Spread granted to every statistic: log word length, log symbols, log repeated lines, repeated share, log words.
FLOOR = (0.06, 0.25, 0.35, 0.10, 1.0)
KEEP, STEPS, LEAST = 0.75, 3, 60
#: Bytes up to which a table with a row a group is broadcast.
BROADCAST_BYTES = 32 << 20
#: Chi-squared with 5 degrees of freedom passes 40 with probability 1.5e-7.
CUTOFF = 40.0
#: h / P(chi2 with 7 degrees <= the 0.75 quantile of chi2 with 5): makes the trimmed scatter consistent.
CONSISTENCY = 1.41
BIN_WIDTH, BINS_AN_OCTAVE = 0.01, 16


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def repeat_words(words: Column, window: int = 3) -> Column:
    """Words that stand in windows of ``window`` words which occur twice or more."""

    def count(hashes: Column) -> Column:
        def from_sorted(order: Column) -> Column:
            again = F.array_distinct(F.filter(order, lambda x, i: x == F.get(order, i - 1)))

            def places(repeated: Column) -> Column:
                few = F.filter(F.transform(hashes, lambda x, i: F.when(F.array_contains(repeated, x), i)), lambda i: i.isNotNull())

                def neighbours(pairs: Column) -> Column:
                    same = lambda p, i: (p["h"] == F.get(pairs, i - 1)["h"]) | (p["h"] == F.get(pairs, i + 1)["h"])
                    return F.sort_array(F.transform(F.filter(pairs, lambda p, i: F.coalesce(same(p, i), F.lit(False))), lambda p: p["i"]))

                many = let(F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), neighbours)
                return F.when(F.size(repeated) <= 24, few).otherwise(many)

            covered = lambda p: window + F.aggregate(
                F.sequence(F.lit(1), F.size(p)), F.lit(0), lambda a, k: a + F.when(k < F.size(p), F.least(F.lit(window), F.get(p, k) - F.get(p, k - 1))).otherwise(0)
            )
            return let(again, lambda r: F.when(F.size(r) == 0, F.lit(0)).otherwise(let(places(r), covered)))

        return let(F.sort_array(hashes), from_sorted)

    every = F.transform(windows(F.size(words), window), lambda i: F.xxhash64(F.slice(words, i, window)))
    return F.when(F.size(words) < window, F.lit(0)).otherwise(let(every, count))


def text_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns but the text; n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) of every whole text."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    made = let(words_of(F.col(text)), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).cast("long").alias("n_repeat_words")))
    return docs.select(
        *[c for c in docs.columns if c != text],
        made.alias("made"),
        (F.char_length(whole) - F.regexp_count(whole, F.lit(SPACE))).cast("long").alias("word_chars"),
        F.regexp_count(whole, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    ).select("*", "made.n_words", "made.n_repeat_words").drop("made")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEAT_PERCENT * F.col("n_words"))


def statistics() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return [
        F.log(F.greatest(F.col("word_chars") / n, F.lit(0.01))),
        F.log1p(100 * F.col("n_symbols") / n),
        F.log1p(F.col("n_dup_lines").cast("double")),
        F.col("n_repeat_words") / n,
        F.log1p(F.col("n_words").cast("double")),
    ]


def cholesky(groups: DataFrame, cov: list[list[str]], keep: list[str]) -> DataFrame:
    """Columns l<i><j> of the lower factor of the matrix whose columns are ``cov`` (lower part), column by column."""
    p = len(STATISTICS)
    out = groups
    for j in range(p):
        diagonal = F.col(cov[j][j])
        for k in range(j):
            diagonal = diagonal - F.col(f"l{j}{k}") * F.col(f"l{j}{k}")
        out = out.withColumn(f"l{j}{j}", F.sqrt(F.greatest(diagonal, F.lit(1e-12))))
        made = {}
        for i in range(j + 1, p):
            value = F.col(cov[i][j])
            for k in range(j):
                value = value - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            made[f"l{i}{j}"] = value / F.col(f"l{j}{j}")
        out = out.withColumns(made) if made else out
    return out.select(*keep, *[f"m{i}" for i in range(p)], *[f"l{i}{j}" for i in range(p) for j in range(i + 1)])


def hinted(groups: DataFrame) -> DataFrame:
    """A table with a row a group, to be broadcast if its bytes, measured as text, are at most BROADCAST_BYTES.

    Left to itself Spark may deal the texts out by group, and a hot group to one task, before it sees how small this is.
    Beyond the bound both sides are shuffled, and Spark splits the hot groups.
    """
    size = groups.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(groups) if size <= BROADCAST_BYTES else groups


def with_distance(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance from the group's estimate; null without one."""
    p = len(STATISTICS)
    out = rows.join(hinted(estimate), "group", "left")
    for i in range(p):
        value = F.col(STATISTICS[i]) - F.col(f"m{i}")
        for k in range(i):
            value = value - F.col(f"l{i}{k}") * F.col(f"z{k}")
        out = out.withColumn(f"z{i}", value / F.col(f"l{i}{i}"))
    d2 = F.lit(0.0)
    for i in range(p):
        d2 = d2 + F.col(f"z{i}") * F.col(f"z{i}")
    return out.select(*rows.columns, d2.alias("d2"))


def start(rows: DataFrame) -> DataFrame:
    """Medians, and quartile ranges as a diagonal scatter, of every group."""
    p = len(STATISTICS)
    binned = rows.select("group", F.posexplode(F.array(*[F.floor(F.col(x) / BIN_WIDTH) for x in STATISTICS])).alias("k", "bin")).groupBy("group", "k", "bin").count()
    up = Window.partitionBy("group", "k").orderBy("bin")
    share = binned.select("group", "k", ((F.col("bin") + 0.5) * BIN_WIDTH).alias("x"), (F.sum("count").over(up) / F.sum("count").over(Window.partitionBy("group", "k"))).alias("s"))
    quartiles = share.groupBy("group", "k").agg(*[F.min(F.when(F.col("s") >= q, F.col("x"))).alias(name) for q, name in ((0.25, "q1"), (0.5, "q2"), (0.75, "q3"))])
    wide = quartiles.groupBy("group").agg(*[F.max(F.when(F.col("k") == i, F.col("q2"))).alias(f"m{i}") for i in range(p)], *[F.max(F.when(F.col("k") == i, (F.col("q3") - F.col("q1")) / 1.349)).alias(f"s{i}") for i in range(p)])
    diagonal = [[F.sqrt(F.col(f"s{i}") * F.col(f"s{i}") + FLOOR[i] ** 2) if i == j else F.lit(0.0) for j in range(i + 1)] for i in range(p)]
    return wide.select("group", *[f"m{i}" for i in range(p)], *[diagonal[i][j].alias(f"l{i}{j}") for i in range(p) for j in range(i + 1)])


def concentrate(rows: DataFrame, estimate: DataFrame, keep: float = KEEP) -> DataFrame:
    """One concentration step: location and scatter of the share ``keep`` of the texts of each group that are nearest to the estimate."""
    p = len(STATISTICS)
    near = with_distance(rows, estimate).withColumn("bin", F.floor(F.log2(F.col("d2") + 1e-9) * BINS_AN_OCTAVE))
    # sums a bin, added up over the bins below the cut: one pass over the rows
    sums = [F.count("*").alias("n")] + [F.sum(x).alias(f"a{i}") for i, x in enumerate(STATISTICS)] + [F.sum(F.col(STATISTICS[i]) * F.col(STATISTICS[j])).alias(f"a{i}{j}") for i in range(p) for j in range(i + 1)]
    bins = near.groupBy("group", "bin").agg(*sums)
    below = F.sum("n").over(Window.partitionBy("group").orderBy("bin")) - F.col("n")
    kept = bins.withColumn("below", below).withColumn("all", F.sum("n").over(Window.partitionBy("group"))).filter(F.col("below") < keep * F.col("all"))
    total = kept.groupBy("group").agg(F.sum("n").alias("n"), *[F.sum(f"a{i}").alias(f"a{i}") for i in range(p)], *[F.sum(f"a{i}{j}").alias(f"a{i}{j}") for i in range(p) for j in range(i + 1)])
    means = total.select("group", *[(F.col(f"a{i}") / F.col("n")).alias(f"m{i}") for i in range(p)], *[(F.col(f"a{i}{j}") / F.col("n")).alias(f"a{i}{j}") for i in range(p) for j in range(i + 1)])
    cov = [[f"c{i}{j}" for j in range(i + 1)] for i in range(p)]
    scatter = means.select("*", *[(CONSISTENCY * (F.col(f"a{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}")) + F.lit(FLOOR[i] ** 2 if i == j else 0.0)).alias(cov[i][j]) for i in range(p) for j in range(i + 1)])
    return cholesky(scatter, cov, ["group"])


def minimum_covariance(fit: DataFrame) -> DataFrame:
    """The estimate of each group with the smallest determinant, of those that concentration steps reach from two starts:
    medians and quartiles, and the mean and covariance of all texts. Equal determinants: the first."""
    spark = fit.sparkSession
    robust = written(spark, start(fit), "mcd-start")
    found = None
    for number, estimate in enumerate((robust, written(spark, concentrate(fit, robust, 1.0), "mcd-start"))):
        for _ in range(STEPS):
            estimate = written(spark, concentrate(fit, estimate), "mcd-step")
        log_det = sum((F.log(f"l{i}{i}") for i in range(1, len(STATISTICS))), F.log("l00"))
        ranked = estimate.withColumn("rank", F.struct(F.round(log_det, 6).alias("det"), F.lit(number).alias("number")))
        found = ranked if found is None else found.unionByName(ranked)
    columns = [c for c in found.columns if c not in ("group", "rank")]
    best = found.groupBy("group").agg(F.min_by(F.struct(*columns), "rank").alias("e")).select("group", *[f"e.{c}" for c in columns])
    return written(spark, best, "mcd")


def with_groups(counts: DataFrame, by: tuple[str, str]) -> DataFrame:
    """Adds group: the text's language and source, or a pool if they have too few texts; null if all are too few."""
    lang, source = by
    passing = counts.filter(~base_failed()).groupBy(lang, source).count()
    per_lang = Window.partitionBy(lang)
    small = F.col("count") < LEAST
    named = (
        passing.withColumn("of_lang", F.sum(F.when(small, F.col("count"))).over(per_lang))
        .withColumn("level", F.when(~small, 0).when(F.col("of_lang") >= LEAST, 1).otherwise(2))
        .select(F.col(lang).alias("g_lang"), F.col(source).alias("g_source"), "count", "level")
    )
    rest = named.filter("level = 2").agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    text = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    name = F.when(F.col("level") == 0, F.concat_ws("/", text("g_lang"), text("g_source"))).when(F.col("level") == 1, text("g_lang"))
    if rest >= LEAST:
        name = name.otherwise(F.lit("rest"))
    named = hinted(written(counts.sparkSession, named.select("g_lang", "g_source", name.alias("group")), "text-groups"))
    same = counts[lang].eqNullSafe(named["g_lang"]) & counts[source].eqNullSafe(named["g_source"])
    return counts.join(named, same, "left").drop("g_lang", "g_source")


def judge(docs: DataFrame, text: str = "text", by: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """doc_id, the counts, base_failed, d2 (null if a plain rule failed or there is no estimate) and kept of every row."""
    spark = docs.sparkSession
    # the only pass over the texts; what follows works on a few numbers a text
    counts = written(spark, text_counts(docs.select("doc_id", *by, text), text), "text-counts")
    rows = with_groups(counts, by).withColumn("base_failed", base_failed()).select("*", *[s.alias(x) for x, s in zip(STATISTICS, statistics(), strict=True)])
    rows = written(spark, rows, "text-statistics")
    fit = rows.filter(~F.col("base_failed") & F.col("group").isNotNull()).select("group", *STATISTICS)
    out = with_distance(rows, minimum_covariance(fit)).withColumn("d2", F.when(~F.col("base_failed"), F.col("d2")))
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= CUTOFF))


def op3_quality_mcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("d2", 3).alias("d2"))
