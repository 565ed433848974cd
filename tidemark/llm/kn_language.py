"""Language identification by interpolated Kneser-Ney character models.

One model a language, over characters of padded words, up to ``ORDER`` characters. All languages share
one sorted array of 64-bit n-gram hashes an order; beside each hash stand, for every language, the
discounted probability and the weight that the n-gram, as a context, gives to the next lower order. A
text's score under a language is its cross-entropy in bits a character, so texts of any length compare;
the lowest wins. A temperature, fitted on documents that gave no counts, turns the differences into
probabilities, and the spread of cross-entropies of those documents calibrates a rejection: a text whose
best cross-entropy is far above what its language's documents show is marked ``rejected``.

The models learn from every teaching document: n-grams are counted by the tasks and merged by grouped sums, and
so are the kinds of characters before and after them. ``MOST_GRAMS`` bounds what workers hold, not the model: beyond
it the rarest n-grams stay in a table. A character's probability hangs on the last ``ORDER`` characters, its window, so
windows that hang on such n-grams are scored by a join with the table, each once, and added to their texts' sums: the
result is that of the whole model. Scoring reads every text whole.

Null texts and texts without a letter are ``und`` with score 0. Null languages teach nothing. Repeated
rows are kept. An empty table, or one that teaches no language, gives ``und`` for every row. Of equal
cross-entropies the language first by name wins. Other columns may have any name but those that are added.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, forget, map_batches, small_batches, table, written

ORDER = 5
#: N-grams of three characters and more that workers hold at most, over all languages; the others are joined.
MOST_GRAMS = 1_000_000
#: Documents a language that are kept from the counts, for temperature and rejection; at most one in CALIBRATION.
CALIBRATION_DOCS, CALIBRATION = 300, 5
#: A text is rejected beyond so many standard deviations of its language's calibration documents.
REJECT_SIGMAS = 6.0
CACHE_BYTES = 64 << 20
#: All n-grams of a model that is not held whole: a row an n-gram, a cell a language.
REST = "k int, h long, n long, cells array<struct<lang:string,mass:double,weight:double,base:double>>"
START, END = 2, 3
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def padded(words: list[str]) -> list[str]:
    return ["\2" + w + "\3" for w in words]


def laid_out(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all (padded) words in a row, the place of each within its word, and its word's number."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(sizes) - sizes
    return codes, np.arange(len(codes)) - np.repeat(starts, sizes), np.repeat(np.arange(len(words)), sizes)


def hashes(codes: np.ndarray, place: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order k: the positions that end a k-gram of one word, and the hashes of those k-grams."""
    out, h = [], codes.copy()
    for k in range(1, ORDER + 1):
        if k > 1:
            h = np.concatenate([h[:1], h[:-1] * MULTIPLIER + codes[1:]])
            h[0] = 0
        at = np.flatnonzero(place >= k - 1)
        mixed = h[at]
        out.append((at, (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)))
    return out


@dataclass
class KneserNey:
    """keys[k]: sorted hashes of order k + 1; mass[k], weight[k]: a row a key, a column a language.

    ``rest`` is the table (``REST``) of all n-grams where not all are held. Those held are the most frequent over all
    languages together, with all their cells, and all of one and two characters.
    """

    languages: list[str]
    keys: list[np.ndarray]
    mass: list[np.ndarray]
    weight: list[np.ndarray]
    floor: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    temperature: float = 1.0
    rest: str | None = None

    def places(self, codes: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log2 probability of each character under each language, and whether it hangs on n-grams that may lie in the rest."""
        index, p = None, np.tile(self.floor, (len(codes), 1))
        hangs = np.zeros(len(codes), bool)
        for k, (at, h) in enumerate(hashes(codes, place)):
            found = np.searchsorted(self.keys[k], h)
            found[found == len(self.keys[k])] = 0
            known = self.keys[k][found] == h
            mass = np.where(known[:, None], self.mass[k][found], 0)
            if k:
                context = index[at - 1]
                weight = np.where((context >= 0)[:, None], self.weight[k - 1][context], 1)
                p[at] = mass + weight * p[at]
            else:
                p[at] = np.where(known[:, None], mass, p[at])
            index = np.full(len(codes), -1)
            index[at] = np.where(known, found, -1)
            if self.rest:
                missing, gone = np.zeros(len(codes), bool), np.zeros(len(codes), bool)
                missing[at] = ~known
                if k > 2:
                    hangs[at] |= unsure[at - 1]  # the context
                if k > 1:
                    gone[at] = absent[at - 1] | absent[at]  # no text holds an n-gram without its parts
                    unsure = missing & ~gone
                    hangs |= unsure
                absent = missing & gone if k > 1 else missing
        logs = np.log2(np.maximum(p, 1e-30))
        logs[place == 0] = 0
        return logs, hangs

    def parts(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
        """log2 probability of each word under each language but for the characters that hang on the rest, its number of predicted characters, and the windows of those that hang."""
        n = len(self.languages)
        windows: list[list[str]] = [[] for _ in words]
        if not words or not n:
            return np.zeros((len(words), n), np.float32), np.zeros(len(words), np.int64), windows
        texts = padded(words)
        codes, place, number = laid_out(texts)
        logs, hangs = self.places(codes, place)
        for i in np.flatnonzero(hangs).tolist():
            end = int(place[i]) + 1
            windows[number[i]].append(texts[number[i]][max(0, end - ORDER) : end])
        logs[hangs] = 0
        begins = np.flatnonzero(place == 0)
        return np.add.reduceat(logs, begins, axis=0), np.diff(np.append(begins, len(codes))) - 1, windows

    def score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """log2 probability of each word under each language, and its number of predicted characters."""
        if self.rest:
            raise ValueError("not all n-grams are held: identify and totals join the rest")
        return self.parts(words)[:2]

    def verdict(self, logs: np.ndarray, n: int) -> tuple[str, float, float | None, bool]:
        """(language or und, score, bits a character, rejected) of a text's log2 probabilities and characters."""
        if not n or not self.languages:
            return "und", 0.0, None, False
        h = -logs / n
        best = int(np.argmin(h))
        p = np.exp(-self.temperature * np.sqrt(n) * (h - h[best]))
        return self.languages[best], float(1 / p.sum()), float(h[best]), bool(h[best] > self.mean[best] + REJECT_SIGMAS * self.spread[best])

    @classmethod
    def of_grams(cls, got: pa.Table) -> KneserNey:
        """The model of (lang, k, h, mass, weight, base) rows."""
        lang = got.column("lang").combine_chunks().dictionary_encode()
        languages = sorted(lang.dictionary.to_pylist())
        column = np.array([languages.index(x) for x in lang.dictionary.to_pylist()])[lang.indices.to_numpy()]
        k, h = got.column("k").to_numpy(), got.column("h").to_numpy().view(np.uint64)
        base = np.zeros(len(languages))
        base[column] = got.column("base").to_numpy()
        kinds = np.array([((k == 0) & (column == j)).sum() for j in range(len(languages))])
        floor = base / (kinds + 1)
        keys, mass, weight = cls.laid(floor, k, h, column, got.column("mass").to_numpy(), got.column("weight").to_numpy())
        n = len(languages)
        return cls(languages, keys, mass, weight, floor.astype(np.float32), np.full(n, np.inf), np.ones(n))

    @staticmethod
    def laid(floor: np.ndarray, k: np.ndarray, h: np.ndarray, column: np.ndarray, masses: np.ndarray, weights: np.ndarray) -> tuple[list, list, list]:
        """keys, mass and weight of cells (order, hash, number of the language, mass, weight)."""
        keys, mass, weight = [], [], []
        for order in range(ORDER):
            at = np.flatnonzero(k == order)
            union, row = np.unique(h[at], return_inverse=True) if len(at) else (np.zeros(1, np.uint64), at)  # an order without n-grams is one key that nothing meets
            # what order 1 leaves goes to all characters alike, those that a language never shows too
            a = np.tile((floor * (order == 0)).astype(np.float32), (len(union), 1))
            w = np.ones((len(union), len(floor)), np.float32)
            a[row, column[at]] += masses[at].astype(np.float32)
            w[row, column[at]] = weights[at]
            keys.append(union)
            mass.append(a)
            weight.append(w)
        return keys, mass, weight

    def calibrate_from(self, told: list[tuple]) -> None:
        """Temperature and spread of cross-entropies from (language, bits a character under each language, characters) of texts that gave no counts."""
        rows, entropies = [], {lang: [] for lang in self.languages}
        for lang, bits, n in told:
            if lang in entropies:
                h = np.asarray(bits)
                rows.append((self.languages.index(lang), h, np.sqrt(n)))
                entropies[lang].append(h[self.languages.index(lang)])
        if not rows:
            return
        best = (np.inf, 1.0)
        for t in 2.0 ** np.arange(-6, 4, 0.5):
            z = [-t * root * (h - h.min()) for _, h, root in rows]
            loss = -np.mean([x[i] - np.log(np.exp(x).sum()) for (i, _, _), x in zip(rows, z, strict=True)])
            best = min(best, (loss, float(t)))
        self.temperature = best[1]
        for j, lang in enumerate(self.languages):
            if len(entropies[lang]) >= 20:
                x = np.array(entropies[lang])
                self.mean[j] = np.median(x)
                self.spread[j] = max(1.4826 * np.median(np.abs(x - self.mean[j])), 0.02)


class Scorer:
    """Scores texts; runs without white space are scored once while they are in the cache."""

    def __init__(self, model: KneserNey):
        self.model = model
        self.rows: dict[str, int] = {}
        self.logs = np.zeros((0, len(model.languages)))
        self.sizes = np.zeros(0, np.int64)
        self.windows: dict[int, list[str]] = {}
        self.held = 0

    def _learn(self, chunks: set[str]) -> None:
        if self.held > CACHE_BYTES:
            self.rows, self.logs, self.sizes, self.windows, self.held = {}, self.logs[:0], self.sizes[:0], {}, 0
        new = [c for c in chunks if c not in self.rows]
        parts = [words_of(c) for c in new]
        known: dict[str, int] = {}
        flat = [known.setdefault(w, len(known)) for p in parts for w in p]
        logs, sizes, windows = self.model.parts(list(known))
        owner = np.repeat(np.arange(len(new)), [len(p) for p in parts])
        held, held_sizes = np.zeros((len(new), logs.shape[1])), np.zeros(len(new), np.int64)
        np.add.at(held, owner, logs[flat])
        np.add.at(held_sizes, owner, sizes[flat])
        self.rows.update(zip(new, range(len(self.logs), len(self.logs) + len(new)), strict=True))
        self.held += sum(map(len, new)) + (150 + 4 * logs.shape[1]) * len(new)
        if any(windows):
            for i, p in enumerate(parts, len(self.logs)):
                if own := [x for w in p for x in windows[known[w]]]:
                    self.windows[i] = own
                    self.held += 200 + 8 * len(own)
            self.held += 80 * sum(map(len, windows))
        self.logs, self.sizes = np.concatenate([self.logs, held.astype(np.float32)]), np.concatenate([self.sizes, held_sizes])

    def settled(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, int, list[str]]]:
        """log2 probabilities of each text but for the characters that hang on the rest, its characters, and the windows of those that hang."""
        runs = [x.split() if x else [] for x in texts]
        want = set().union(*runs)
        if not all(map(self.rows.__contains__, want)):
            self._learn(want if self.held > CACHE_BYTES else want - self.rows.keys())
        for chunks in runs:
            at = np.fromiter(map(self.rows.__getitem__, chunks), np.int64, len(chunks))
            windows = [x for i in at.tolist() for x in self.windows.get(i, ())] if self.windows else []
            yield self.logs[at].sum(0, dtype=np.float64), int(self.sizes[at].sum()), windows

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float | None, bool]]:
        """(language or und, score, bits a character, rejected) of each text."""
        if self.model.rest:
            raise ValueError("not all n-grams are held: identify joins the rest")
        return [self.model.verdict(logs, n) for logs, n, _ in self.settled(texts)]


class GramCounts:
    """Distinct n-grams of one language and their counts, merged as batches come."""

    def __init__(self):
        self.words: Counter = Counter()
        self.parts: list[list[tuple]] = [[] for _ in range(ORDER)]
        self.size = 0

    def add(self, text: str) -> None:
        self.words.update(words_of(text))
        if len(self.words) > 50_000:
            self.settle()

    def settle(self) -> None:
        words = list(self.words)
        if not words:
            return
        times = np.fromiter(self.words.values(), np.int64, len(words))
        self.words = Counter()
        codes, place, number = laid_out(padded(words))
        shorter = np.zeros(len(codes), np.uint64)
        for k, (at, h) in enumerate(hashes(codes, place)):
            key, first, inverse = np.unique(h, return_index=True, return_inverse=True)
            spot = at[first]
            context = shorter[spot - 1] if k else np.zeros(len(key), np.uint64)
            self.parts[k].append((key, shorter[spot], context, place[spot] == k, codes[spot] != START, np.bincount(inverse, times[number[at]], len(key)).astype(np.int64)))
            self.size += len(key)
            shorter = np.zeros(len(codes), np.uint64)
            shorter[at] = h
        if self.size > 2_000_000:
            self.parts = [[self.merged(k)] for k in range(ORDER)]
            self.size = sum(len(p[0][0]) for p in self.parts)

    def merged(self, k: int) -> tuple:
        columns = [np.concatenate(c) for c in zip(*self.parts[k], strict=True)]
        _, first, inverse = np.unique(columns[0], return_index=True, return_inverse=True)
        return *[c[first] for c in columns[:-1]], np.bincount(inverse, columns[-1], len(first)).astype(np.int64)


GRAMS = "lang string, k int, h long, suffix long, context long, initial boolean, ends boolean, n long"


def counted_grams(rows: DataFrame) -> DataFrame:
    """Every distinct n-gram of every language (of ``rows``: lang, text) with its count, suffix, context, and whether it
    begins a word or may be predicted. Tasks merge their own; a grouped sum merges theirs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, GramCounts] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(lang, GramCounts()).add(text)
        for lang, counts in held.items():
            counts.settle()
            for k in range(ORDER if counts.parts[0] else 0):
                h, suffix, context, initial, ends, n = counts.merged(k)
                for i in range(0, len(h), 50_000):
                    j = slice(i, i + 50_000)
                    m = len(h[j])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * m), pa.array(np.full(m, k, np.int32)), *[pa.array(x[j].view(np.int64)) for x in (h, suffix, context)], pa.array(initial[j]), pa.array(ends[j]), pa.array(n[j])],
                        ["lang", "k", "h", "suffix", "context", "initial", "ends", "n"],
                    )

    grams = rows.select("lang", "text").mapInArrow(count, GRAMS)
    return grams.groupBy("lang", "k", "h").agg(F.first("suffix").alias("suffix"), F.first("context").alias("context"), F.max("initial").alias("initial"), F.max("ends").alias("ends"), F.sum("n").alias("n"))


def discounted(grams: DataFrame) -> DataFrame:
    """(lang, k, h, n, mass, weight): the discounted probability of each n-gram after its context, and what it leaves, as a context, to the next lower order."""
    kinds = grams.filter("k > 0").groupBy("lang", (F.col("k") - 1).alias("k"), F.col("suffix").alias("h")).agg(F.count("*").alias("kinds"))
    # kinds of characters before it; at a word's start, and at the highest order, plain counts stay
    c = F.when(F.col("initial") | (F.col("k") == ORDER - 1), F.col("n")).otherwise(F.coalesce("kinds", F.lit(0)))
    counted = grams.join(kinds, ["lang", "k", "h"], "left").withColumn("c", c)
    seen = counted.filter("ends")
    ones, twos = F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)
    rates = seen.groupBy("lang", "k").agg(F.when((ones > 0) & (twos > 0), ones / (ones + 2 * twos)).otherwise(0.5).alias("d"))  # a row a language and order
    contexts = seen.groupBy("lang", "k", "context").agg(F.sum("c").alias("total"), F.count("*").alias("followers"))
    contexts = contexts.join(F.broadcast(rates), ["lang", "k"]).withColumn("left", F.col("d") * F.col("followers") / F.col("total"))
    both = counted.join(contexts, ["lang", "k", "context"], "left")
    mass = F.when(F.col("ends"), F.greatest(F.col("c") - F.col("d"), F.lit(0.0)) / F.col("total")).otherwise(0.0)
    leaves = contexts.filter("k > 0").select("lang", (F.col("k") - 1).alias("k"), F.col("context").alias("h"), F.col("left").alias("weight"))
    base = contexts.filter("k = 0").select("lang", F.col("left").alias("base"))
    out = both.select("lang", "k", "h", "n", mass.alias("mass")).join(leaves, ["lang", "k", "h"], "left").join(F.broadcast(base), "lang", "left")  # a row a language
    return out.select("lang", "k", "h", "n", "mass", F.coalesce("weight", F.lit(1.0)).alias("weight"), "base")


def fit_languages(df: DataFrame, teaches: Column, lang: str = "lang", text: str = "text", id_col: str = "doc_id", most_grams: int = MOST_GRAMS, calibration_docs: int = CALIBRATION_DOCS) -> KneserNey:
    """Learns from all rows where ``teaches`` holds and the language is not null.

    Counts, discounts and weights are grouped sums over the n-grams of every whole text. ``most_grams`` bounds what
    comes to the driver and goes to the executors: if there are more n-grams, those of the lowest counts over all
    languages stay in a table, which ``totals`` joins. About ``calibration_docs`` documents a language, picked by a hash of
    their id, give no counts but temperature and spread; they are scored where they lie.
    """
    spark = df.sparkSession
    small_batches(spark)
    rows = df.filter(teaches & F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}  # a row a language
    nothing = KneserNey([], [], [], [], np.zeros(0), np.zeros(0), np.zeros(0))
    if not sizes:
        return nothing
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1 / CALIBRATION, calibration_docs / n))])
    unit = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("calibration")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    split = rows.select(F.col(lang).alias("lang"), (unit < share[F.col(lang)]).alias("aside"), F.col(text).alias("text"))
    grams = written(spark, counted_grams(split.filter("not aside")), "grams")
    made = written(spark, discounted(grams), "discounted")
    columns, rest = ["lang", "k", "h", "mass", "weight", "base"], None
    if made.filter("k > 1").count() <= most_grams:
        got = made.select(*columns).toArrow()
    else:
        cells = F.collect_list(F.struct("lang", "mass", "weight", "base")).alias("cells")  # a cell a language
        every = written(spark, made.groupBy("k", "h").agg(F.sum("n").alias("n"), cells), "rest")
        rest = every.written_path
        # an n-gram's parts are as frequent as itself or more, so where it is held they are
        often = F.floor(F.log2("n") * 32)
        by_count = every.filter("k > 1").groupBy(often.alias("often")).agg(F.sum(F.size("cells")).alias("cells")).collect()  # 2,048 rows at most
        least, total = 1 << 20, 0
        for r in sorted(by_count, reverse=True):
            total += r["cells"]
            if total > most_grams:
                break
            least = r["often"]
        got = every.filter((F.col("k") <= 1) | (often >= least)).select("k", "h", F.inline("cells")).select(*columns).toArrow()
    forget(grams, made)
    if not got.num_rows:
        return nothing
    model = KneserNey.of_grams(got)
    model.rest = rest
    told = totals(split.filter("aside").select("lang", "text"), model, ["lang"]).filter("n > 0").collect()  # some numbers a calibration document
    model.calibrate_from(sorted((r["lang"], [-x / r["n"] for x in r["logs"]], r["n"]) for r in told))
    return model


_scorers: dict[str, Scorer] = {}


def _scorer(name: str, model: Broadcast) -> Scorer:
    if name not in _scorers:
        _scorers.clear()
        _scorers[name] = Scorer(model.value)
    return _scorers[name]


def window_logs(windows: DataFrame, model: KneserNey) -> DataFrame:
    """(w, more): log2 probabilities of the last character of each distinct window, from the n-grams of the rest's table."""
    spark = windows.sparkSession
    languages, floor = {x: j for j, x in enumerate(model.languages)}, model.floor

    def needs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, place, number = laid_out(batch.column(0).to_pylist())
            last = np.append(place[1:] == 0, True)
            ends = last | np.append(last[1:], False)  # the last character's n-grams, and their contexts
            for k, (at, h) in enumerate(hashes(codes, place)):
                at, h = at[ends[at]], h[ends[at]]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(number[at])), pa.array(np.full(len(at), k, np.int32)), pa.array(h.view(np.int64))], ["w", "k", "h"])

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = {(g["k"], g["h"]): g["cells"] for found in batch.column(1).to_pylist() for g in found if g["cells"]}
            flat = [(k, h, languages[c["lang"]], c["mass"], c["weight"]) for (k, h), cells in own.items() for c in cells]
            k, h, column, mass, weight = (np.array(x, kind) for x, kind in zip(zip(*flat, strict=True) if flat else [()] * 5, (int, np.int64, int, float, float), strict=True))
            n = len(languages)
            part = KneserNey(list(languages), *KneserNey.laid(floor, k, h.view(np.uint64), column, mass, weight), floor, np.ones(n), np.ones(n))
            codes, place, _ = laid_out(batch.column(0).to_pylist())
            logs = part.places(codes, place)[0][np.append(place[1:] == 0, True)] if len(codes) else np.zeros((0, n))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(logs.astype(float).tolist(), pa.list_(pa.float64()))], ["w", "more"])

    wanted = windows.mapInArrow(needs, "w string, k int, h long")
    found = wanted.join(spark.read.schema(REST).parquet(model.rest).select("k", "h", "cells"), ["k", "h"], "left")
    return found.groupBy("w").agg(F.collect_list(F.struct("k", "h", "cells")).alias("found")).mapInArrow(scores, "w string, more array<double>")  # 2 * ORDER - 1 n-grams a window


def totals(df: DataFrame, model: KneserNey, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, then logs (log2 probability of the text under each language) and n (its predicted characters).

    Where the model is not held whole, the windows that hang on the rest go through a join, each distinct one once.
    """
    spark = df.sparkSession
    held = spark.sparkContext.broadcast(model)  # bounded by MOST_GRAMS
    name = uuid.uuid4().hex

    def work(batch):
        found = list(_scorer(name, held).settled(batch.column(text).to_pylist()))
        return {"logs": [x.tolist() for x, _, _ in found], "n": [n for _, n, _ in found], "open": [w for _, _, w in found]}

    schema = T.StructType([T.StructField("logs", T.ArrayType(T.DoubleType())), T.StructField("n", T.LongType()), T.StructField("open", T.ArrayType(T.StringType()))])
    parts = map_batches(df.withColumn("row_", F.monotonically_increasing_id()), [*keep, "row_"], work, schema, [text])
    if not model.rest:
        return parts.select(*keep, "logs", "n")
    parts = written(spark, parts, "parts")
    hanging = parts.select("row_", F.explode("open").alias("w"))
    more = F.array(*[F.sum(F.col("more")[j]) for j in range(len(model.languages))]).alias("more")
    gained = hanging.join(window_logs(hanging.select("w").distinct(), model), "w").groupBy("row_").agg(more)
    both = F.coalesce(F.zip_with("logs", "more", lambda x, y: x + y), "logs")
    return parts.join(gained, "row_", "left").select(*keep, both.alias("logs"), "n")


def identify(df: DataFrame, model: KneserNey, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, then lang_pred, score, bits (a character under that language) and rejected."""
    small_batches(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(model)  # bounded by MOST_GRAMS
    name = uuid.uuid4().hex

    def work(batch):
        if held.value.rest:
            found = [held.value.verdict(np.array(x), n) for x, n in zip(batch.column("logs").to_pylist(), batch.column("n").to_pylist(), strict=True)]
        else:
            found = _scorer(name, held).predict(batch.column(text).to_pylist())
        return dict(zip(("lang_pred", "score", "bits", "rejected"), map(list, zip(*found, strict=True)), strict=True)) if found else {"lang_pred": [], "score": [], "bits": [], "rejected": []}

    schema = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return map_batches(totals(df, model, keep, text), keep, work, schema, ["logs", "n"]) if model.rest else map_batches(df, keep, work, schema, [text])


def op9_language_kn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    part = crc_mod("doc_id", 4)
    model = fit_languages(docs, part != 2)
    out = identify(docs.select("doc_id", "text", F.coalesce(part == 2, F.lit(False)).alias("held_out")), model, ["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "lang_pred", "score", "bits", "rejected")
