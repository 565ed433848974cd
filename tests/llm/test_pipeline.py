"""The pipeline against its stages done by plain means."""

from __future__ import annotations

import hashlib
import struct
from collections import defaultdict

from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import decontaminate, pii_feistel, quality_ri
from tidemark.llm.bpe_dp import vocabulary_path
from tidemark.llm.common import crc_mod, table

from .conftest import ODD, doc, with_clashes
from .test_near import brute


def test_run_against_plain_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = [tuple(r) for r in docs.collect()]
    vectors = quality_ri.word_vectors(docs)
    network = quality_ri.fit_quality(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0, vectors)
    scores = network.scores(quality_ri.Pooler(vectors).features([r[1] for r in rows]))
    rows = [r for r, s in zip(rows, scores, strict=True) if s >= quality_ri.THRESHOLD]
    groups = defaultdict(list)
    for r, (_, least, _) in zip(rows, brute(rows), strict=True):
        groups[least].append(r)
    rows = [min(g) for g in groups.values()]
    bad = {r["doc_id"] for r in decontaminate.op7_template_decontamination(spark, sf_dir).collect() if r["contaminated"]}
    rows = [r for r in rows if r[0] not in bad]
    library, p = Tokenizer.from_file(vocabulary_path("word_bpe_49k.json")), pii_feistel.Pseudonymiser(pii_feistel.DEMO_KEY)
    want = []
    for d, x, lang, source, _ in rows:
        ids = library.encode(p.text(x)[0], add_special_tokens=False).ids
        want.append((d, lang, source, len(ids), struct.pack(f"<{len(ids)}I", *ids), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = [(r["doc_id"], r["lang"], r["source"], r["n_tokens"], bytes(r["ids"]), r["decoded_sha256"]) for r in corpus_pipeline.run(spark, sf_dir).collect()]
    assert sorted(got) == sorted(want)


def test_stages_keep_columns_and_odd_rows(spark, tables):
    d = tables(documents=[*ODD, doc(50, "which of the following small animals lives under water for all its life")], labels=[(i, 1, 0) for i in range(1, 8)], benchmark=[(1, "which of the following small animals lives under water for all its life")])
    docs = with_clashes(table(spark, d, "documents"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns
        docs = out
    got = docs.collect()
    assert 50 not in {r["doc_id"] for r in got} and {1, 2, 3, 4, 7} <= {r["doc_id"] for r in got}
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, d).count() == len(got)


def test_empty_tables(spark, tables):
    assert corpus_pipeline.run(spark, tables()).count() == 0
