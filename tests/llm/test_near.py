"""op6 against brute force."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest

from tidemark.llm import near_jaccard as nj
from tidemark.llm.common import table
from tidemark.llm.components import components

from .conftest import ODD, doc, with_clashes


def brute(rows):
    """(links, smallest id of the class) of each row, by comparing all pairs of shingle sets."""

    def sets(x):
        w = (x or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    s = [sets(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and 10 * len(s[i] & s[j]) >= 8 * len(s[i] | s[j]):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = defaultdict(lambda: None)
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least[find(i)] if least[find(i)] is not None else r[0])
    return [(r[0], least[find(i)] if s[i] else r[0], links[i]) for i, r in enumerate(rows)]


def corpus():
    """Exact copies, a large group of near copies, chains, a passage in many documents, short texts."""
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    rows, base = [], [rnd.choice(words) for _ in range(120)]
    for i in range(700):  # more than a block, so pairs of blocks are dealt out
        w = list(base)
        for _ in range(rnd.randrange(3)):
            w[rnd.randrange(len(w))] = rnd.choice(words)
        rows.append(doc(1000 + i, " ".join(w)))
    passage = [rnd.choice(words) for _ in range(60)]
    for i in range(150):
        rows.append(doc(5000 + i, " ".join([rnd.choice(words) for _ in range(rnd.randrange(5, 300))] + passage)))
    chain = [rnd.choice(words) for _ in range(400)]
    for i in range(12):
        rows.append(doc(6000 + i, " ".join(chain[5 * i : 5 * i + 200])))
    for i in range(40):
        rows.append(doc(7000 + i, "exact copy of one text in many rows " * 3))
    rows += [doc(8000 + i, " ".join(words[i : i + i % 7])) for i in range(30)]
    return rows + ODD


def test_against_all_pairs(spark, tables):
    rows = corpus()
    got = sorted(map(str, ((r["doc_id"], r["class_id"], r["n_links"]) for r in nj.op6_near_jaccard(spark, tables(documents=rows)).collect())))
    assert got == sorted(map(str, brute(rows)))


def test_long_chains_beside_dense_groups(spark, tables, monkeypatch):
    """With small blocks a chain's nodes have few surviving pairs for its many blocks: they are verified pair by pair."""
    monkeypatch.setattr(nj, "BLOCK", 4)
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(5000)]
    chain = rnd.sample(words, 400)
    rows = [doc(100 + i, " ".join(chain[i : i + 70])) for i in range(160)]
    base = chain[160:230]  # a dense group that hangs on the chain
    for i in range(40):
        w = list(base)
        w[rnd.randrange(len(w))] = rnd.choice(words)
        rows.append(doc(1000 + i, " ".join(w)))
    other = [rnd.choice(words) for _ in range(90)]
    for i in range(30):  # and one that does not, with copies
        w = list(other)
        w[rnd.randrange(len(w))] = rnd.choice(words)
        rows += [doc(2000 + i, " ".join(w))] * (1 + i % 3)
    rnd.shuffle(rows)
    seen = []
    plain = nj.verified_pairs
    monkeypatch.setattr(nj, "verified_pairs", lambda *args: seen.append(1) or plain(*args))
    got = sorted(map(str, ((r["doc_id"], r["class_id"], r["n_links"]) for r in nj.op6_near_jaccard(spark, tables(documents=rows)).collect())))
    assert got == sorted(map(str, brute(rows))) and seen


def test_empty_table(spark, tables):
    d = tables()
    assert nj.op6_near_jaccard(spark, d).count() == 0
    assert nj.one_of_each_class(table(spark, d, "documents")).count() == 0


def test_one_of_each_class(spark, tables):
    rows = [*ODD, doc(20, "one two three four five six seven"), doc(21, "one two three four five six seven"), doc(21, "one two three four five six seven")]
    docs = with_clashes(table(spark, tables(documents=rows), "documents"))
    got = nj.one_of_each_class(docs)
    assert got.columns == docs.columns
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in got.collect()))) == sorted(map(str, {(r[0], r[1]) for r in rows if r[0] != 21}))


def test_pruning_table_is_monotone_and_safe():
    least = nj.least_matches()
    assert least == sorted(least) and len(least) == nj.HASHES // nj.STEP
    rng = np.random.default_rng(1)
    agree = rng.random((20_000, nj.HASHES)) < 0.8 + 0.2 / 256
    lost = np.zeros(len(agree), bool)
    for k, m in enumerate(least, 1):
        lost |= agree[:, : k * nj.STEP].sum(1) < m
    assert lost.mean() < 1e-3


def test_minhash_estimates_jaccard():
    rng = np.random.default_rng(4)
    a = np.unique(rng.integers(0, 1 << 63, 1000, np.uint64))
    b = np.concatenate([a[:700], np.unique(rng.integers(0, 1 << 63, 300, np.uint64))])
    assert abs(np.mean(nj.minhash(a) == nj.minhash(np.sort(b))) - 700 / 1300) < 0.15


def test_spark_hash_is_spark(spark):
    from pyspark.sql import functions as F

    rows = [(b"0123456789abcdef", 5), (b"x" * 16, None), (b"\0" * 16, -(2**62))]
    want = [r[0] for r in spark.createDataFrame(rows, "n binary, d long").select(F.xxhash64("n", "d")).collect()]
    assert nj._spark_hash([r[0] for r in rows], [r[1] for r in rows]).tolist() == want


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rnd = random.Random(seed)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {x: x for e in edges for x in e}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        root[b] = a
    assert got == {x: find(x) for u, v in edges if u != v for x in (u, v)}
