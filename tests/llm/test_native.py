"""op2, op3 and op7, which stay inside the JVM, against brute force."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate as dc
from tidemark.llm import license_join as lj
from tidemark.llm import quality_mcd as mcd
from tidemark.llm.common import table

from .conftest import ODD, doc, with_clashes

PYTHON_NODES = re.compile(r"Python|Pandas|Arrow|BatchEval")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- license scan ----------------------------------------------------------------------------------

LICENSED = [
    doc(100, "Intro. Licensed under the Apache License, Version 2.0.\nmore"),
    doc(101, "MIT License mit license MIT-LICENSE"),
    doc(102, "this program: it under the terms of the GNU General Public License as published by the Free Software Foundation; either"),
    doc(103, "Licensed under CC BY-NC 4.0. And cc by again"),
    doc(104, "permission hereby granted free of charge any person obtaining a copy of this software and associated documentation files to"),
    doc(105, "the mit of license under released"),
    doc(106, "K MITİ LICENSE cc by gnu  general\npublic license"),
    doc(107, None),
]


def brute_licenses(rows):
    out = []
    for d, x, *_ in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
        places = [(i, label) for p, label in lj.PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        labels, best, held = set(), 0.0, set()
        for k, (t, label, deciding) in enumerate(lj.TEMPLATES):
            every = re.findall("[a-z0-9]+", t.lower())
            tw, deciding = set(every), deciding.split()
            for i in range(len(words)):
                run = words[i : i + 2 * len(every)]
                found = len(tw.intersection(run))
                if found >= math.ceil(lj.THRESHOLD * len(tw) - 1e-9) and any(run[j : j + len(deciding)] == deciding for j in range(len(run))):
                    labels.add(label)
                    best = max(best, found / len(tw))
                    held.add(k)
        base = {label for _, label in places}
        out.append((d, len(words), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), 1.0 if places else best, len(held)))
    return out


def test_op2_against_all_runs(spark, tables):
    rows = [r for r in ODD if r[0] != 4] + LICENSED + [doc(200 + i, x) for i, (x, _) in enumerate(NOTICES)]
    df = lj.op2_license_join(spark, tables(documents=rows))
    assert not PYTHON_NODES.search(plan_of(df))
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, brute_licenses(rows)))
    assert lj.op2_license_join(spark, tables()).count() == 0
    assert lj.op2_license_join(spark, tables(documents=ODD)).count() == len(ODD)


#: Notices as they are published, hard-wrapped, and texts that are none; with the labels that the method must give.
NOTICES = [
    ('Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal\nin the Software without restriction', {"mit"}),
    ("# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions are met:\n#", {"bsd"}),
    ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that", {"isc"}),
    ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy", {"mpl-2.0"}),
    ("it under the terms of the GNU Affero General Public License as\npublished by the Free Software Foundation, either", {"agpl"}),
    ("it under the terms of the GNU General Public License as published by\nthe Free Software Foundation", {"gpl"}),
    ("Licensed under the Apache License, Version 2.0", {"apache", "apache-2.0"}),
    ("Licensed under CC BY 4.0", {"cc-by", "cc-by-4.0"}),
    ("Licensed under CC BY-NC 4.0", {"cc-by", "cc-by-nc-4.0"}),
    ("Licensed under CC BY-SA 4.0", {"cc-by", "cc-by-sa-4.0"}),
    ("Licensed under CC BY-ND 4.0", {"cc-by", "cc-by-nd-4.0"}),
    ("Licensed under CC BY-NC-SA 4.0", {"cc-by", "cc-by-nc-sa-4.0"}),
    ("under the license released by MIT press, see the terms", set()),
    ("This work is licensed under the GNU General Public License, version 3", {"gpl", "gpl-3.0"}),
    ("released into " + "other words here " * 60 + "the public domain this is free and unencumbered", set()),
    ("x y z " * 70 + "Released under the MIT\r\nLicense " + "x y z " * 70, {"mit"}),
]


@pytest.mark.parametrize("k", range(0, 400, 37))
def test_notices_get_their_own_labels_only(spark, k):
    shift = "word " * k  # notices at every place of a block
    df = spark.createDataFrame([(i, shift + x) for i, (x, _) in enumerate(NOTICES)], "doc_id long, text string")
    got = {i: set() for i in range(len(NOTICES))}
    for r in lj.template_matches(df).collect():
        got[r["doc_id"]].add(r["label"])
    bases = {label for _, label in lj.PHRASES}
    for i, (x, want) in enumerate(NOTICES):
        assert got[i] - bases == want - bases or got[i] == want, x


def test_op2_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet')")
    want = con.execute(lj.op2_sql()).fetchall()
    assert sorted(map(str, want)) == sorted(map(str, map(tuple, lj.op2_license_join(spark, sf_dir).collect())))


def test_filters_lose_no_pair(spark):
    rnd = random.Random(8)
    words = [f"t{i}" for i in range(30)]
    templates = [(x := " ".join(rnd.sample(words, rnd.randrange(2, 12))), f"l{i}", x.split()[0]) for i in range(12)]
    rows = [(i, " ".join(rnd.choice([*words, "zz"]) for _ in range(rnd.randrange(1, 120)))) for i in range(150)]
    for threshold in (0.5, 0.8, 1.0):
        got = {(r["doc_id"], r["template"]) for r in lj.template_matches(spark.createDataFrame(rows, "doc_id long, text string"), templates, threshold).collect()}
        want = set()
        for d, x in rows:
            w = x.split()
            for k, (t, _, deciding) in enumerate(templates):
                runs = [w[i : i + 2 * len(t.split())] for i in range(len(w))]
                if any(deciding in r and len(set(r) & set(t.split())) >= max(1, math.ceil(threshold * len(set(t.split())) - 1e-9)) for r in runs):
                    want.add((d, k))
        assert got == want


# --- quality rules ---------------------------------------------------------------------------------


def plain_counts(x):
    x = x or ""
    w = [a for a in re.split(r"[\x20\x09-\x0D]+", x) if a]
    seen = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [a for a in x.split("\n") if re.search(r"[^\x20\x09-\x0D]", a)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), len(lines) - len(set(lines)), len(covered)


def test_op3_counts(spark, tables):
    rnd = random.Random(2)
    rows = [doc(i, " ".join(rnd.choice("a b c d ee\n ff\t gg #x *** a b".split(" ")) for _ in range(rnd.randrange(120)))) for i in range(100, 200)] + ODD
    df = mcd.op3_quality_mcd(spark, tables(documents=rows))
    assert not PYTHON_NODES.search(plan_of(df))
    got = df.collect()
    want = []
    for d, x, *_ in rows:
        c = plain_counts(x)
        want.append((d, *c, c[0] < 50 or 100 * c[4] > 50 * c[0]))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert sorted(str(tuple(r[n] for n in names)) for r in got) == sorted(map(str, want))
    assert not any(r["kept"] and r["base_failed"] for r in got)
    assert mcd.op3_quality_mcd(spark, tables()).count() == 0


def test_estimates_are_the_numpy_ones(spark, tmp_path):
    rng = np.random.default_rng(3)
    good = rng.multivariate_normal(np.zeros(5), np.diag([0.01, 0.2, 0.1, 0.02, 1.0]) + 0.005, 900)
    bad = rng.normal(3, 0.2, (100, 5))
    x = np.concatenate([good, bad])
    rows = spark.createDataFrame([("g", *map(float, r)) for r in x], "group string, " + ", ".join(f"{s} double" for s in mcd.STATISTICS))
    estimate = mcd.start(rows)
    for _ in range(mcd.STEPS):
        before = np.array([r["d2"] for r in mcd.with_distance(rows, estimate).collect()])
        estimate = mcd.concentrate(rows, estimate)
    # numpy: the same step from the distances before it
    bins = np.floor(np.log2(before + 1e-9) * mcd.BINS_AN_OCTAVE)
    order = np.unique(bins)
    below = np.array([(bins < b).sum() for b in order])
    keep = np.isin(bins, order[below < mcd.KEEP * len(x)])
    xs = np.array([[r[s] for s in mcd.STATISTICS] for r in rows.collect()])[keep]
    cov = mcd.CONSISTENCY * np.cov(xs.T, bias=True) + np.diag(np.square(mcd.FLOOR))
    lower = np.linalg.cholesky(cov)
    e = estimate.first()
    assert np.allclose([e[f"m{i}"] for i in range(5)], xs.mean(0), atol=1e-6)
    assert np.allclose([[e[f"l{i}{j}"] if j <= i else 0 for j in range(5)] for i in range(5)], lower, atol=1e-6)
    d2 = np.array([r["d2"] for r in mcd.with_distance(rows, estimate).orderBy(F.monotonically_increasing_id()).collect()])
    assert (d2[900:] > mcd.CUTOFF).all() and (d2[:900] < mcd.CUTOFF).all()


def plain_mcd(x, rng, starts=30):
    """Location and scatter of the subset with the smallest determinant, by concentration to the end from random starts."""
    h, best = int(np.ceil(mcd.KEEP * len(x))), (np.inf, None)
    for _ in range(starts):
        at = rng.choice(len(x), 8, replace=False)
        for _ in range(50):
            mean, cov = x[at].mean(0), np.cov(x[at].T, bias=True) + 1e-9 * np.eye(x.shape[1])
            d2 = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            new = np.sort(np.argsort(d2, kind="stable")[:h])
            if np.array_equal(new, at):
                break
            at = new
        best = min(best, (np.linalg.slogdet(cov)[1], tuple(at)), key=lambda b: b[0])
    at = np.array(best[1])
    return x[at].mean(0), mcd.CONSISTENCY * np.cov(x[at].T, bias=True) + np.diag(np.square(mcd.FLOOR))


@pytest.mark.parametrize("share", [0.05, 0.2])
def test_verdicts_are_those_of_a_plain_minimum_covariance_determinant(spark, share):
    rng = np.random.default_rng(7)
    scatter = np.diag([0.01, 0.2, 0.1, 0.02, 1.0]) + 0.004
    groups = {}
    for name, shift in (("a", 0.0), ("b", 2.0)):
        bad = int(800 * share)
        groups[name] = np.concatenate([rng.multivariate_normal(np.full(5, shift), scatter, 800 - bad), rng.normal(shift + 4, 0.3, (bad, 5))])
    rows = spark.createDataFrame([(g, *map(float, r)) for g, x in groups.items() for r in x], "group string, " + ", ".join(f"{s} double" for s in mcd.STATISTICS))
    estimate = mcd.minimum_covariance(rows)
    found = {}
    for r in mcd.with_distance(rows, estimate).collect():
        found.setdefault(r["group"], {})[tuple(r[s] for s in mcd.STATISTICS)] = r["d2"]
    for g, x in groups.items():
        mean, cov = plain_mcd(x, rng)
        d2 = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
        ours = np.array([found[g][tuple(map(float, r))] for r in x])
        assert ((ours > mcd.CUTOFF) == (d2 > mcd.CUTOFF)).all() and (ours > mcd.CUTOFF).sum() == int(800 * share)
        e = estimate.filter(F.col("group") == g).first()
        assert np.allclose([e[f"m{i}"] for i in range(5)], mean, atol=0.08)


def test_op3_rejects_junk_and_keeps_prose(spark, tables):
    rnd = random.Random(4)
    words = [f"{a}{b}" for a in "ka to mi ne ru so".split() for b in "la de fi go pu".split()] + ["of", "the", "and"]
    rows = [doc(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(60, 400))), source=f"s{i % 3}") for i in range(400)]
    rows += [doc(1000 + i, " ".join(rnd.choice(words) + "&&&" for _ in range(rnd.randrange(60, 400))), source=f"s{i % 3}") for i in range(20)]
    got = {r["doc_id"]: r["kept"] for r in mcd.op3_quality_mcd(spark, tables(documents=rows)).collect()}
    assert not any(got[1000 + i] for i in range(20))
    assert np.mean([got[i] for i in range(400)]) > 0.97


# --- decontamination ---------------------------------------------------------------------------------

ITEMS = [
    (1, "A train leaves Paris at 9 and travels 120 km in 2 hours, then it waits 9 minutes before it goes on to Lyon."),
    (2, "which of the following small animals lives under water for all of its long and quiet life"),
    (3, "too short"),
    (4, "Five words stand here alone"),
    (5, None),
]


def test_templates_catch_reworded_numbers_and_names(spark, tables):
    text = {
        10: "so A train leaves Rome at 7 and travels 333 km in 5 hours, then it waits 7 minutes before it goes on to Bari. end",
        11: "so A train leaves Rome at 7 and travels 333 km in 5 hours, then it waits 8 minutes before it goes on to Bari. end",
        12: "WHICH OF THE following small animals, lives under water for all of its long and quiet life?",
        13: "which of the following small birds lives over water for all of its short and loud life",
        14: "x y z Five words stand here alone, indeed",
        15: "Five words stand there alone",
        16: "nothing of the sort",
        17: None,
    }
    rows = [doc(i, x) for i, x in text.items()] + ODD
    df = dc.op7_template_decontamination(spark, tables(documents=rows, benchmark=ITEMS))
    assert not PYTHON_NODES.search(plan_of(df))
    got = {r["doc_id"]: r["items"] for r in df.collect() if r["contaminated"]}
    assert got == {10: [1], 12: [2], 14: [4]}  # 11 gives one repeated value two values


def test_op7_against_plain_windows(spark):
    sf = "/root/testdata/sf0.01"
    words = lambda x: re.findall(r"[^\W_]+", x.lower())
    index = defaultdict(set)
    for r in table(spark, sf, "benchmark").collect():
        w = words(r["text"])
        for k in range(len(w) - 7):
            index[tuple(w[k : k + 8])].add((r["item_id"], k))
    want = set()
    for r in table(spark, sf, "documents").collect():
        w, covered = words(r["text"]), defaultdict(set)
        for k in range(len(w) - 7):
            for item, j in index.get(tuple(w[k : k + 8]), ()):
                covered[item, k - j].update(range(j, j + 8))
        if any(len(c) >= dc.COVERED for c in covered.values()):
            want.add(r["doc_id"])
    got = {r["doc_id"] for r in dc.op7_template_decontamination(spark, sf).collect() if r["contaminated"]}
    assert got == want and want


def test_op7_edges(spark, tables):
    assert dc.op7_template_decontamination(spark, tables()).count() == 0
    d = tables(documents=ODD)
    assert not any(r["contaminated"] for r in dc.op7_template_decontamination(spark, d).collect())
    docs = with_clashes(table(spark, tables(documents=[*ODD, doc(50, ITEMS[1][1]), doc(50, ITEMS[1][1])], benchmark=ITEMS), "documents"))
    kept = dc.clean(docs, spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert kept.columns == docs.columns and kept.count() == len(ODD)


def items_found(spark, tables, item, texts):
    """The places, in texts, of the texts that the item contaminates."""
    df = dc.op7_template_decontamination(spark, tables(documents=[doc(i, x) for i, x in enumerate(texts)], benchmark=[(1, item)]))
    return [r["doc_id"] for r in df.orderBy("doc_id").collect() if r["contaminated"]]


def test_op7_items_full_of_numbers(spark, tables):
    item = "Compute the sum 48 + 17 + 36 + 25 + 91 + 60"
    assert items_found(spark, tables, item, [item, f"so {item}, please", "Compute the sum 12 + 33 + 54 + 75 + 26 + 87"]) == [0, 1]


def test_op7_copies_with_a_shift(spark, tables):
    item = "when the long day was over and the shop closed Anna counted all of her apples and gave half away"
    longer, word = item.replace("Anna", "Mary Ann"), item.replace("closed", "finally closed")
    assert items_found(spark, tables, item, [longer, word, item.replace("shop ", ""), "when the long day was over and the shop closed we slept"]) == [0, 1, 2]
    twice = "a train that leaves at 9 with all its people on board still waits here for 9 whole minutes each day"
    shifted = twice.replace("board", "board today")
    assert items_found(spark, tables, twice, [shifted.replace("9", "7"), shifted.replace("9 whole", "8 whole")]) == [0]


def test_op7_copies_in_another_case(spark, tables):
    item = "What is the capital of France and which river flows through Paris"
    other = "Two friends of Rosa drive 120 km from Berlin to Prague and then walk 7 more"
    texts = [item, item.lower(), item.upper(), item.title(), item.replace(" ", "  ")]
    assert items_found(spark, tables, item, [*texts, "what is the capital of france"]) == [0, 1, 2, 3, 4]
    assert items_found(spark, tables, other, [x.replace("120", "95") for x in (other.lower(), other.upper(), other.title(), "so " + other)]) == [0, 1, 2, 3]


def test_pair_and_window_maps_only_save_work(spark):
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice(["one", "two", "three", "so Paris", "so Rome", "7", "km", "four"]) for _ in range(rnd.randrange(0, 40))) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    full, empty = (dc.long_array([x] * 128) for x in (-1, 0))
    sizes = [4, 5, 8]
    got = df.select(*[F.array_sort(F.transform(dc.matches_of(F.col("t"), sizes, m), lambda w: F.struct(w["size"], w["at"], w["hash"]))).alias(n) for n, m in (("all", None), ("mapped", (full, full)), ("none", (empty, full)))]).collect()
    assert all(r["all"] == r["mapped"] and not r["none"] for r in got) and sum(len(r["all"]) for r in got) > 1000


def brute_templates(text, item):
    """Whether an item contaminates a text, by plain loops over all windows."""

    def canonical(x):
        words = [(m[0], bool(re.search(r"[a-zà-ÿ0-9,;]\s+$", x[: m.start()]) and re.match("[A-Z][a-z]", m[0]))) for m in re.finditer(r"[^\W\d_]+|\d+(?:[.,:]\d+)*", x)]
        kinds = []
        for i, (w, name) in enumerate(words):
            number = w[0].isdigit()
            kinds.append("N" if number else "U" if w.lower() in dc.UNITS and i and words[i - 1][0][0].isdigit() else "M" if name else None)
        return [w.lower() for w, _ in words], kinds

    def sides(x):
        words, kinds = canonical(x)
        places = [i for i, k in enumerate(kinds) if not (k == "M" and i and kinds[i - 1] == "M")]
        ends = [*places[1:], len(words)]
        for kind in ("template", "names", "plain"):
            if kind == "template":
                seq = [(i, e - 1, f"\x01{kinds[i]}" if kinds[i] else words[i], " ".join(words[i:e]), kinds[i]) for i, e in zip(places, ends, strict=True)]
            else:
                seq = [(i, i, f"\x01{k}" if k and (k != "M") and kind == "names" else w, w, k) for i, (w, k) in enumerate(zip(words, kinds, strict=True))]
            for at in range(len(seq)):
                yield kind, at, seq

    def windows(x, n):
        out = defaultdict(list)
        for kind, at, seq in sides(x):
            part = seq[at : at + n]
            if len(part) < n:
                continue
            slots = sum(bool(k) for *_, k in part) if kind == "template" else sum(bool(k) and k != "M" for *_, k in part)
            if (kind == "plain") != (2 * slots > n):
                continue
            out[tuple(c for _, _, c, _, _ in part)].append((part[0][0], part[-1][1], [v for *_, v, _ in part], [bool(k) for *_, k in part]))
        return out

    m = re.match(r"\s*[A-Z][a-z]", item)
    marked = ", " + item.lstrip() if m else item
    words, kinds = canonical(marked)
    n_template = len([i for i, k in enumerate(kinds) if not (k == "M" and i and kinds[i - 1] == "M")])
    n_words = len(words)
    if n_words < dc.SHORTEST:
        return canonical(text)[0] == canonical(item)[0]
    n = min(n_template if n_template >= dc.SHORTEST else n_words, dc.WINDOW)
    theirs = windows(item, n)
    for key, found in windows(marked, n).items():
        theirs[key] += [w for w in found if w[0] == 0]
    if words[0] in dc.UNITS:
        for key, found in windows("0 " + item, n).items():
            theirs[key] += [(a - 1, b - 1, v, s) for a, b, v, s in found if a == 1]
    lines = defaultdict(lambda: (set(), set()))
    for key, ours in windows(text, n).items():
        for a, b, values, slots in theirs.get(key, ()):
            for at, _, mine, own in ours:
                lines[at - a][0].update(range(a, b + 1))
                lines[at - a][1].update((v, w) for v, w, s, t in zip(values, mine, slots, own, strict=True) if s or t)
    sound = lambda pairs: len({v for v, _ in pairs}) == len(pairs)
    lines = {k: v for k, v in lines.items() if sound(v[1])}
    for near in {k // dc.DRIFT for k in lines} | {k // dc.DRIFT - 1 for k in lines}:
        some = sorted(((len(p), k, sorted(p), q) for k, (p, q) in lines.items() if k // dc.DRIFT in (near, near + 1)), key=lambda x: x[:3], reverse=True)
        covered, pairs = set(), set()
        for _, _, p, q in some:
            if sound(pairs | q):
                covered.update(p)
                pairs |= q
        if len(covered) >= dc.COVERED or len(covered) >= dc.SHARE * n_words:
            return True
    return False


def test_op7_against_plain_templates(spark, tables):
    rnd = random.Random(11)
    vocabulary = "the of and train apples river goes takes holds long small old red counts under over market street boy girl km kg hours".split()
    names = ["Anna", "Paris", "Mary Ann", "Lyon", "Tom"]
    some = lambda: rnd.choice(names) if rnd.random() < 0.15 else str(rnd.randrange(20)) if rnd.random() < 0.15 else rnd.choice(vocabulary)
    items = [" ".join(some() for _ in range(rnd.choice([2, 3, 5, 6, 9, 14, 22]))) for _ in range(16)]
    texts = []
    for _ in range(120):
        words = rnd.choice(items).split()
        for _ in range(rnd.randrange(0, 4)):
            i = rnd.randrange(len(words))
            change = rnd.random()
            words[i : i + 1] = [] if change < 0.2 else [words[i], some()] if change < 0.4 else [some()] if change < 0.7 else [words[i].upper()]
        texts.append(" ".join([some() for _ in range(rnd.randrange(6))] + words + [some() for _ in range(rnd.randrange(6))]) if rnd.random() < 0.8 else " ".join(words))
    df = dc.op7_template_decontamination(spark, tables(documents=[doc(i, x) for i, x in enumerate(texts)], benchmark=list(enumerate(items))))
    got = {r["doc_id"]: r["items"] for r in df.collect()}
    want = {i: [k for k, item in enumerate(items) if brute_templates(x, item)] for i, x in enumerate(texts)}
    assert got == want and sum(map(bool, want.values())) > 30


def test_op7_short_items_items_without_id_and_other_numerals(spark, tables):
    items = [(1, "two words"), (None, "an item without an id still keeps its copies out of the documents"), (3, "add ٣ and ٤ apples to the basket of the old man")]
    texts = ["Two words", "two words more", "see an item without an id still keeps its copies out of the documents", "add ٥ and ٦ apples to the basket of the old man"]
    df = dc.op7_template_decontamination(spark, tables(documents=[doc(i, x) for i, x in enumerate(texts)], benchmark=items))
    assert [(r["contaminated"], r["items"]) for r in df.orderBy("doc_id").collect()] == [(True, [1]), (False, []), (True, []), (True, [3])]
