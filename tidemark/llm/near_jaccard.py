"""N-gram Jaccard join: all texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Words are runs without white space, in lower case; a text of one to four words is one shingle. Texts with
equal shingle sets are one *node* with a number of copies; only nodes are compared.

1. A pass over the texts gives each its node (a 128-bit hash of its shingle set), a MinHash signature of
   ``HASHES`` values, kept as 8 bits each, and the hashes of ``BANDS`` bands of ``BAND_ROWS`` values.
2. Nodes that share a band's hash are candidates. Buckets of more than ``BLOCK`` nodes are cut into blocks,
   and pairs of blocks are dealt out, so no task holds a bucket. A pair counts in its first common
   band only. Bayesian pruning compares its signatures ``STEP`` values at a time and drops it as soon as the
   posterior probability (uniform prior) that the similarity reaches the threshold is below ``TOLERANCE``.
3. Pairs that remain join their nodes into candidate groups (connected components).
4. A second pass over the texts takes the shingle sets of one text a node in a group, picked by a bit map of
   bounded size; groups are again dealt out in pairs of blocks, and pairs inside a group are verified
   exactly, by products of incidence matrices. Links are counted there, no pair is written out. A group of n
   nodes costs each of them n / BLOCK copies, so in groups of many blocks the *lone* nodes, those with fewer
   surviving pairs than half the blocks (long chains of versions), are taken out: their pairs, so few, are pruned
   once more, written and verified singly. Work thus follows the surviving pairs in sparse groups, and in
   dense ones the blocks.
5. Exact links give the final classes (connected components).

A pair at the threshold misses every band with probability (1 - 0.8^5)^32 = 3e-6, and is pruned wrongly with
probability below the tolerance; nothing else is approximate, and there is no cap on partners or candidates.

Null and empty texts, and texts of white space, have no shingles: each is a class of its own with no links.
Null ids are kept and never name a class unless all ids of it are null. Repeated rows are copies; of equal smallest ids
one names the class. An empty table gives an empty one. Only id and text are read, so other columns may have any name;
``one_of_each_class`` passes them on, if they do not end in two underscores. Intermediate tables are deleted, but for
the signatures and the classes, which the result reads.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import TwoGenerations, claim, forget, map_batches, small_batches, table, written
from .components import components

SHINGLE, THRESHOLD = 5, 0.8
BANDS, BAND_ROWS = 32, 5
HASHES = BANDS * BAND_ROWS
STEP, TOLERANCE = 32, 1e-6
BLOCK = 512
#: Shingles of a block of texts: groups of very long texts are cut into more blocks.
BLOCK_SHINGLES = 2_000_000
#: Bits of the map of wanted rows: 16 a row, and at most 2^28 (32 MB) whatever the number of rows.
BITS_A_ROW, MOST_BITS = 16, 1 << 28

_rng = np.random.default_rng(20_240_517)
FACTORS = (_rng.integers(0, 1 << 32, HASHES, np.uint64) | np.uint64(1)).astype(np.uint32)
OFFSETS = _rng.integers(0, 1 << 32, HASHES, np.uint64).astype(np.uint32)
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)
_words = TwoGenerations(lambda w: xxhash.xxh64_intdigest(w.lower().encode("utf-8", "surrogatepass")))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _Q
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = text.split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    size = min(SHINGLE, len(h))
    n = len(h) - size + 1
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = _mix(out * _P + h[k : k + n])
    return np.unique(out)


def node_of(found: np.ndarray) -> bytes | None:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None


def minhash(found: np.ndarray) -> np.ndarray:
    x = (found >> np.uint64(32)).astype(np.uint32)
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        part = x[i : i + 2048, None] * FACTORS
        part += OFFSETS
        np.minimum(low, part.min(0), out=low)
    return low


def bands_of(low: np.ndarray) -> np.ndarray:
    h = np.full(BANDS, 1, np.uint64)
    for column in low.reshape(BANDS, BAND_ROWS).T.astype(np.uint64):
        h = _mix(h * _P + column)
    return (h >> np.uint64(32)).astype(np.uint32)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """For each step, the matches that a pair needs so far: with fewer, the posterior is below the tolerance.

    Signature values of 8 bits also agree by chance, so a similarity s agrees with probability s + (1 - s) / 256.
    """
    s = (np.arange(20_000) + 0.5) / 20_000
    c = s + (1 - s) / 256
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        for m in range(n + 1):
            like = m * np.log(c) + (n - m) * np.log1p(-c)
            like = np.exp(like - like.max())
            if like[s >= threshold].sum() >= tolerance * like.sum():
                out.append(m)
                break
    return out


def roots_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of the component of each of range(n), for pairs (a, b)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while not np.array_equal(root, again := root[root]):
            root = again
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups of rows with equal keys, several at a time, from batches sorted by the keys."""
    rest: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        new = np.ones(t.num_rows, bool)
        new[1:] = False
        for k in keys:
            x = t.column(k).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        starts = np.flatnonzero(new)
        same = bool(rest) and all(rest[-1].column(k)[-1] == t.column(k)[0] for k in keys)
        if rest and not same:
            yield pa.concat_tables(rest)
            rest = []
        if same and len(starts) > 1:
            yield pa.concat_tables([*rest, t.slice(0, starts[1])])
            rest, t, starts = [], t.slice(starts[1]), starts[1:] - starts[1]
        if same and len(starts) == 1 and rest:
            rest.append(t)
        else:
            if starts[-1]:
                yield t.slice(0, starts[-1])
            rest = [t.slice(starts[-1])]
    if rest:
        yield pa.concat_tables(rest)


def _cuts(t: pa.Table, keys: list[str]) -> list[tuple[int, int]]:
    new = np.ones(t.num_rows, bool)
    new[1:] = False
    for k in keys:
        x = t.column(k).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    starts = np.flatnonzero(new)
    return list(zip(starts.tolist(), [*starts[1:].tolist(), t.num_rows], strict=True))


def _pairs(left: np.ndarray, right: np.ndarray, at_once: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of a row in the left block and one in the right; of one block, each pair once."""
    if right is left:
        for i in range(0, len(left), at_once):
            a, b = np.nonzero(np.arange(len(left)) > np.arange(i, min(i + at_once, len(left)))[:, None])
            yield left[a + i], left[b]
    else:
        for i in range(0, len(left), at_once):
            part = left[i : i + at_once]
            yield np.repeat(part, len(right)), np.tile(right, len(part))


def _in_blocks(df: DataFrame, key: str, blocks: Column, node: str) -> DataFrame:
    """Adds lo, hi (a pair of blocks) and left (whether the row is of block lo): each row once for every block of its key.

    ``blocks``: the number of blocks of the row's key.
    """
    own = F.when(blocks <= 1, F.lit(0)).otherwise(F.pmod(F.xxhash64(node, F.lit("block")), blocks).cast("int"))
    many = df.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = many.select("*", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") <= F.col("other")).alias("left")).drop("own", "other")
    return dealt.repartition(key, "lo", "hi").sortWithinPartitions(key, "lo", "hi")


def signatures(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, node, n_shingles, signature (8 bits a hash) and bands of every text."""
    small_batches(docs.sparkSession)

    def work(batch):
        out: dict = {"node": [], "n_shingles": [], "signature": [], "bands": []}
        for x in batch.column(text).to_pylist():
            found = shingles(x)
            low = minhash(found) if len(found) else None
            out["node"].append(node_of(found))
            out["n_shingles"].append(len(found))
            out["signature"].append(None if low is None else (low & 255).astype(np.uint8).tobytes())
            out["bands"].append(None if low is None else bands_of(low).tobytes())
        return out

    schema = T.StructType([T.StructField("node", T.BinaryType()), T.StructField("n_shingles", T.IntegerType()), T.StructField("signature", T.BinaryType()), T.StructField("bands", T.BinaryType())])
    return map_batches(docs, keep, work, schema, [text])


def _buckets(nodes: DataFrame, done: list[DataFrame]) -> DataFrame:
    """Rows of ``nodes`` (node, n_shingles, signature, bands and further columns), one for each bucket and pair of blocks.

    Buckets are counted by a grouped count and the counts, written, are joined back: Spark splits that join where a bucket
    is hot. The written table joins ``done``, to be deleted when the rows have been used.
    """

    def spread(batches):
        for batch in batches:
            rows = batch.num_rows
            if rows:
                keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(rows, BANDS)
                bucket = (np.arange(BANDS, dtype=np.int64) << 32) | keys.astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(bucket.ravel()), batch.column(0).take(pa.array(np.repeat(np.arange(rows), BANDS)))], ["bucket", "node"])

    spread_rows = nodes.select("node", "bands").mapInArrow(spread, "bucket long, node binary")
    sizes = written(nodes.sparkSession, spread_rows.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1"), "buckets")
    done.append(sizes)
    shared = spread_rows.join(sizes.hint("merge"), "bucket")
    return _in_blocks(shared.join(nodes, "node"), "bucket", F.ceil(F.col("size") / BLOCK).cast("int"), "node")


BUCKET_ROW = ["bucket", "lo", "hi", "left", "node", "n_shingles", "signature", "bands"]


def _survivors(t: pa.Table, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (rows of t) of whole pairs of blocks that survive the pruning; each pair in its first common band only."""
    n = t.num_rows
    sizes = t.column("n_shingles").to_numpy()
    band = t.column("bucket").to_numpy() >> 32
    bands = np.frombuffer(b"".join(t.column("bands").to_pylist()), np.uint32).reshape(n, BANDS)
    sign = np.frombuffer(b"".join(t.column("signature").to_pylist()), np.uint8).reshape(n, HASHES)
    left = t.column("left").to_numpy()
    found_a, found_b = [], []
    small_a, small_b = [], []

    def test(a, b):
        ok = 10 * np.minimum(sizes[a], sizes[b]) >= 8 * np.maximum(sizes[a], sizes[b])
        a, b = a[ok], b[ok]
        ok = (bands[a] == bands[b]).argmax(1) == band[a]  # in an earlier band's bucket it is tested there
        a, b = a[ok], b[ok]
        matches = np.zeros(len(a), np.int64)
        for k, need in enumerate(least):
            matches += np.count_nonzero(sign[a, k * STEP : (k + 1) * STEP] == sign[b, k * STEP : (k + 1) * STEP], axis=1)
            ok = matches >= need
            a, b, matches = a[ok], b[ok], matches[ok]
        found_a.append(a)
        found_b.append(b)

    lo, hi = t.column("lo").to_numpy(), t.column("hi").to_numpy()
    for start, end in _cuts(t, ["bucket", "lo", "hi"]):
        if end - start == 2 and lo[start] == hi[start]:
            small_a.append(start)
            small_b.append(start + 1)
            continue
        at = np.arange(start, end)
        x = at if lo[start] == hi[start] else at[left[start:end]]
        y = x if lo[start] == hi[start] else at[~left[start:end]]
        for a, b in _pairs(x, y):
            test(a, b)
    if small_a:
        test(np.array(small_a), np.array(small_b))
    none = [np.zeros(0, int)]
    return np.concatenate(found_a or none), np.concatenate(found_b or none)


def candidate_edges(nodes: DataFrame, done: list[DataFrame]) -> DataFrame:
    """(u, v, degree): star edges (degree null) over the pairs of ``nodes`` that survive the pruning, and (v null) parts of each node's number of such pairs."""
    least = least_matches()

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, ["bucket", "lo", "hi"]):
            a, b = _survivors(t, least)
            root = roots_of(t.num_rows, a, b)
            edge = np.flatnonzero(root != np.arange(t.num_rows))
            degree = np.bincount(a, minlength=t.num_rows) + np.bincount(b, minlength=t.num_rows)
            some = np.flatnonzero(degree)
            node = t.column("node").combine_chunks()
            u = node.take(pa.array(np.concatenate([edge, some])))
            v = pa.concat_arrays([node.take(pa.array(root[edge])), pa.nulls(len(some), pa.binary())])
            yield pa.RecordBatch.from_arrays([u, v, pa.array([None] * len(edge) + degree[some].tolist(), pa.int64())], ["u", "v", "degree"])

    return _buckets(nodes, done).select(*BUCKET_ROW).mapInArrow(prune, "u binary, v binary, degree long")


def candidate_pairs(nodes: DataFrame, done: list[DataFrame]) -> DataFrame:
    """(u, v): the pairs that survive the pruning and of which at least one node is marked ``lone``."""
    least = least_matches()

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, ["bucket", "lo", "hi"]):
            a, b = _survivors(t, least)
            lone = t.column("lone").to_numpy()
            ok = lone[a] | lone[b]
            node = t.column("node").combine_chunks()
            yield pa.RecordBatch.from_arrays([node.take(pa.array(a[ok])), node.take(pa.array(b[ok]))], ["u", "v"])

    return _buckets(nodes, done).select(*BUCKET_ROW, "lone").mapInArrow(prune, "u binary, v binary")


def wanted_map(rows: DataFrame, key: str) -> np.ndarray:
    """A bit map over hashes of ``key`` (long), of bounded size: a row whose bit is unset is not wanted."""
    n = rows.count()
    bits = min(MOST_BITS, max(1 << 16, 1 << (n * BITS_A_ROW - 1).bit_length() if n else 0))
    place = F.pmod(F.col(key), F.lit(bits))
    words = rows.select((place / 64).cast("long").alias("w"), F.expr(f"shiftleft(1L, cast(pmod({key}, 64) as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    out = np.zeros(bits // 64, np.int64)
    t = words.toArrow()  # at most bits / 64 rows
    out[t.column("w").to_numpy()] = t.column("b").to_numpy()
    return out


def shingle_sets(docs: DataFrame, members: DataFrame, text: str = "text") -> DataFrame:
    """(node, shingles) of ``members`` (node, doc_id of the text that stands for it): the second pass over the texts."""
    spark = docs.sparkSession
    stands = F.xxhash64("node", "doc_id")
    bit_map = spark.sparkContext.broadcast(wanted_map(members.select(stands.alias("h")), "h"))  # 32 MB at most

    def read(batches):
        claim(__name__)
        bits = bit_map.value
        for batch in batches:
            ids, hashes, sets = [], [], []
            for d, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = shingles(x)
                if len(found):
                    ids.append(d)
                    hashes.append(node_of(found))
                    sets.append(found)
            h = _spark_hash(hashes, ids) if ids else np.zeros(0, np.int64)
            place = np.mod(h, len(bits) * 64)
            at = np.flatnonzero((bits[place >> 6] >> (place & 63)) & 1)
            yield pa.RecordBatch.from_arrays([pa.array([hashes[i] for i in at], pa.binary()), pa.array([ids[i] for i in at], pa.int64()), pa.array([sets[i].tobytes() for i in at], pa.binary())], ["node", "doc_id", "shingles"])

    return docs.select(F.col("doc_id").cast("long"), text).mapInArrow(read, "node binary, doc_id long, shingles binary")


def verified(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, links, root) parts: links of a node inside a pair of blocks, and the smallest row it is joined to there.

    ``members``: node, group, blocks (of the group), copies, doc_id (of the text that stands for the node).
    """
    same = [members["node"] == sets["node"], members["doc_id"].eqNullSafe(sets["doc_id"])]
    rows = members.join(sets, same).select(members["node"], "group", "blocks", "copies", "shingles")
    dealt = _in_blocks(rows, "group", F.col("blocks"), "node")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, ["group", "lo", "hi"]):
            node, copies = t.column("node").combine_chunks(), t.column("copies").to_numpy()
            names, raw, left = node.to_pylist(), t.column("shingles").to_pylist(), t.column("left").to_numpy()
            lo, hi = t.column("lo").to_numpy(), t.column("hi").to_numpy()
            held, links, to = [], [], []
            for start, end in _cuts(t, ["group", "lo", "hi"]):
                at = [i for k, i in enumerate(range(start, end)) if names[i] not in names[start:i]] if end - start < 8 else list({names[i]: i for i in range(start, end)}.values())
                inter, sizes = intersections([np.frombuffer(raw[i], np.uint64) for i in at])
                joined = 10 * inter >= 8 * (sizes[:, None] + sizes[None, :] - inter)
                np.fill_diagonal(joined, False)
                at = np.array(at)
                if lo[start] != hi[start]:
                    joined &= left[at][:, None] != left[at][None, :]
                a, b = np.nonzero(np.triu(joined))
                root = roots_of(len(at), a, b)
                held.append(at)
                links.append(joined @ copies[at])
                to.append(at[root])
            if held:
                held, to = np.concatenate(held), np.concatenate(to)
                yield pa.RecordBatch.from_arrays([node.take(pa.array(held)), pa.array(np.concatenate(links).astype(np.int64)), node.take(pa.array(to))], ["node", "links", "root"])

    return dealt.select("group", "lo", "hi", "left", "node", "copies", "shingles").mapInArrow(verify, "node binary, links long, root binary")


def verified_pairs(pairs: DataFrame, members: DataFrame, sets: DataFrame) -> DataFrame:
    """The same parts from single pairs (u, v) of nodes: both shingle sets of each are compared."""
    same = [members["node"] == sets["node"], members["doc_id"].eqNullSafe(sets["doc_id"])]
    rows = members.join(sets, same).select(members["node"], "copies", "shingles").dropDuplicates(["node"])
    side = lambda x: rows.select(*[F.col(c).alias(f"{c}_{x}") for c in rows.columns])
    both = pairs.join(side("u"), F.col("u") == F.col("node_u")).join(side("v"), F.col("v") == F.col("node_v"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(k).to_pylist() for k in (2, 5))
            keep = []
            for i in range(batch.num_rows):
                x, y = np.frombuffer(a[i], np.uint64), np.frombuffer(b[i], np.uint64)
                inter = len(np.intersect1d(x, y, assume_unique=True))
                if 10 * inter >= 8 * (len(x) + len(y) - inter):
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            u, v, copies_u, copies_v = (batch.column(k).take(at) for k in (0, 3, 1, 4))
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([u, v]), pa.concat_arrays([copies_v, copies_u]).cast(pa.int64()), pa.concat_arrays([v, u])], ["node", "links", "root"])

    return both.select("node_u", "copies_u", "shingles_u", "node_v", "copies_v", "shingles_v").mapInArrow(verify, "node binary, links long, root binary")


def intersections(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of all pairwise intersections, and of the sets."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    _, which, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1  # others are in no intersection
    number = np.cumsum(shared) - 1
    owner = np.repeat(np.arange(n), sizes)
    keep = shared[which]
    owner, column = owner[keep], number[which[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    inter = np.zeros((n, n), np.float32)
    wide = 4096
    for first in range(0, int(shared.sum()), wide):
        a, b = np.searchsorted(column, [first, first + wide])
        m = np.zeros((n, wide), np.float32)
        m[owner[a:b], column[a:b] - first] = 1
        inter += m @ m.T
    inter = np.rint(inter).astype(np.int64)
    np.fill_diagonal(inter, sizes)
    return inter, sizes


def _spark_hash(nodes: list[bytes], ids: list) -> np.ndarray:
    """Spark's xxhash64 of (node, doc_id): its seed is 42, each column seeds the next, nulls are passed over."""
    out = np.empty(len(nodes), np.uint64)
    for i, (n, d) in enumerate(zip(nodes, ids, strict=True)):
        h = xxhash.xxh64_intdigest(n, 42)
        out[i] = h if d is None else xxhash.xxh64_intdigest(d.to_bytes(8, "little", signed=True), h)
    return out.view(np.int64)


def near_classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Of every row: doc_id, text_hash (Spark's xxhash64 of the text), class_node (names its class; null without shingles),
    class_id (smallest id of its class), copy_of (smallest id with the same shingles), n_links (other rows it is linked to).
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = written(spark, signatures(docs.withColumn("text_hash", F.xxhash64("text")), ["doc_id", "text_hash"]), "signatures")
    each = signed.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("copy_of"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"), F.min("signature").alias("signature"), F.min("bands").alias("bands"))
    nodes = written(spark, each, "nodes")
    told = nodes.select("node", "n_shingles", "signature", "bands")
    done: list[DataFrame] = [nodes]
    pruned = written(spark, candidate_edges(told, done), "pruned")
    group = components(pruned.filter("v is not null").select("u", "v"))
    degrees = pruned.filter("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("degree").alias("degree"))
    held = group.join(nodes.select("node", "copy_of", "copies", "n_shingles"), "node").join(degrees, "node")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int")
    members = held.join(held.groupBy("root").agg(blocks.alias("blocks")), "root").select("node", "root", "blocks", "copies", F.col("copy_of").alias("doc_id"), "n_shingles", (2 * F.col("degree") < F.col("blocks")).alias("lone"))
    members = written(spark, members, "members")
    # of the others: their own blocks
    dense = members.filter("not lone")
    blocks = dense.groupBy("root").agg(blocks.alias("blocks"))
    dense = dense.drop("blocks").join(blocks, "root").select("node", F.xxhash64("root").alias("group"), "blocks", "copies", "doc_id")
    sets = shingle_sets(docs, members)
    parts = verified(dense, sets)
    if not members.filter("lone").isEmpty():
        sets = written(spark, sets, "shingles")
        done.append(sets)
        mixed = members.groupBy("root").agg(F.max("lone").alias("mixed")).filter("mixed").select("root")
        marked = told.join(members.join(mixed, "root").select("node", "lone"), "node")
        pairs = written(spark, candidate_pairs(marked, done), "pairs")
        done.append(pairs)
        parts = verified(dense, sets).unionByName(verified_pairs(pairs, members.select("node", "copies", "doc_id"), sets))
    parts = written(spark, parts, "verified")
    # the links of a group may be dealt over several pairs of blocks: their parts are joined here
    classes = components(parts.select(F.col("node").alias("u"), F.col("root").alias("v")))
    links = parts.groupBy("node").agg(F.sum("links").alias("links"))
    names = classes.join(nodes.select("node", "copy_of"), "node").groupBy("root").agg(F.min("copy_of").alias("class_id"))
    final = nodes.select("node", "copy_of", "copies").join(classes.join(names, "root").select("node", "root", "class_id"), "node", "left").join(links, "node", "left")
    final = final.select("node", "copy_of", F.coalesce("root", "node").alias("class_node"), F.coalesce("class_id", "copy_of").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    named = written(spark, final, "classes")
    forget(*done, pruned, group, members, parts, classes)  # only the signatures and the classes are read on
    rows = signed.select("doc_id", "text_hash", "node").join(named, "node", "left")
    alone = F.col("node").isNull()
    return rows.select(
        "doc_id",
        "text_hash",
        "class_node",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("copy_of")).alias("copy_of"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def one_of_each_class(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The row with the smallest id of each class, with all its columns; rows without shingles all stay.

    Of rows with equal id and text one stays, by a grouped choice that combines before the shuffle.
    """
    rows = near_classes(docs, text, doc_id)
    id_key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    alone = rows.filter("class_node is null").select(id_key.alias("id_key__"), F.col("text_hash").alias("text_hash__"), F.lit(True).alias("alone__")).distinct()
    first = rows.filter("class_node is not null").groupBy("class_node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_hash")).alias("k"))
    first = first.select(F.coalesce(F.col("k.doc_id").cast("string"), F.lit("null")).alias("id_key__"), F.col("k.text_hash").alias("text_hash__"), F.lit(False).alias("alone__"))
    stays = written(docs.sparkSession, alone.unionByName(first), "stays")
    keyed = docs.select("*", F.coalesce(F.col(doc_id).cast("long").cast("string"), F.lit("null")).alias("id_key__"), F.xxhash64(text).alias("text_hash__"), F.monotonically_increasing_id().alias("place__"))
    kept = keyed.join(stays, ["id_key__", "text_hash__"]).withColumn("place__", F.when(F.col("alone__"), F.col("place__")).otherwise(F.lit(-1)))
    return kept.dropDuplicates(["id_key__", "text_hash__", "place__"]).select(*docs.columns)


def op6_near_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "copy_of", "n_links")
