"""op8 and op10 against the tokenizers library."""

from __future__ import annotations

import hashlib
import io
import random
import struct
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidemark.llm import bpe_dp, token_sst
from tidemark.llm.common import table

from .conftest import ODD

PIECES = ["a", "aa", "the", "THE", " ", "  ", "\n", "\t", "'s", "'", "ing", "é", "e\u0301", "ß", "Σ", "ΑΣ", "İ", "\u212a", "\x1c", "\x85", "\u2003", "\u3000", "日本", "👍🏽", "123", "½", "<|endoftext|>", "<|startoftext|>", "<|", "!!", "...", "\0", "zzzz", "\u0300", "\n\n"]


@pytest.fixture(scope="module")
def libraries():
    return {n: Tokenizer.from_file(bpe_dp.vocabulary_path(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json")}


def texts(n):
    rnd = random.Random(5)
    return ["".join(rnd.choice(PIECES) for _ in range(rnd.randrange(14))) for _ in range(n)]


def test_prefix_encoding_is_the_library(libraries):
    library = libraries["word_bpe_49k.json"]
    with open(bpe_dp.vocabulary_path("word_bpe_49k.json"), "rb") as f:
        mine = bpe_dp.tokenizer(f.read())
    for x in texts(3000):
        ids, n, decoded = mine.encode(x)
        want = library.encode(x, add_special_tokens=False).ids
        assert list(struct.unpack(f"<{n}I", ids)) == want, repr(x)
        assert decoded == library.decode(want, skip_special_tokens=False), repr(x)


def test_every_vocabulary_word(libraries):
    library = libraries["word_bpe_49k.json"]
    with open(bpe_dp.vocabulary_path("word_bpe_49k.json"), "rb") as f:
        mine = bpe_dp.tokenizer(f.read())
    words = [w.removesuffix("</w>") for w in list(library.get_vocab())[::7]]
    for w in words:
        assert list(struct.unpack(f"<{mine.encode(w)[1]}I", mine.encode(w)[0])) == library.encode(w, add_special_tokens=False).ids


def test_cached_chunks_are_the_library(libraries):
    library = libraries["byte_bpe_50k.json"]
    mine = token_sst.CachedEncoder(library.to_str())
    for x in texts(5000):
        assert np.frombuffer(mine.encode(x), f"<u{mine.id_width}").tolist() == library.encode(x, add_special_tokens=False).ids, repr(x)


def test_caches_forget_and_agree(libraries):
    from tidemark.llm.common import TwoGenerations

    cache = TwoGenerations(lambda k: k * 2, most_bytes=600)
    assert [cache[k] for k in "abcdabeacd" * 3] == [k * 2 for k in "abcdabeacd" * 3]
    assert len(cache) <= 4 and len(cache.old) <= 4
    cache["x" * 1000], cache["y"], cache["z" * 1000], cache["y"]
    assert sum(map(len, cache)) + sum(map(len, cache.old)) <= 2010


def test_op8_query(spark, tables, libraries):
    library = libraries["word_bpe_49k.json"]
    got = bpe_dp.op8_bpe_codec(spark, tables(documents=ODD)).collect()
    want = []
    for d, x, *_ in ODD:
        ids = library.encode(x or "", add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_op10_query(spark, tables, libraries):
    library = libraries["byte_bpe_50k.json"]
    got = [tuple(r) for r in token_sst.op10_token_sst(spark, tables(documents=ODD)).collect()]
    at, want = 0, {}
    for d, x, *_ in sorted(ODD, key=lambda r: (r[0] is not None, r[0])):
        ids = [*library.encode(x or "", add_special_tokens=False).ids, 2]
        want.setdefault(d, []).append((at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    assert len(got) == len(ODD)
    places = sorted((s, n) for _, s, n, _ in got)
    assert all(a + n == b for (a, n), (b, _) in zip(places, places[1:], strict=False)) and places[0][0] == 0
    for d in want:  # rows with one id may stand in any order among themselves
        assert sorted((n, c) for i, _, n, c in got if i == d) == sorted((n, c) for _, n, c in want[d])
        assert min(s for i, s, _, _ in got if i == d) == min(s for s, _, _ in want[d])


def test_empty_table(spark, tables):
    d = tables()
    assert bpe_dp.op8_bpe_codec(spark, d).count() == 0 and token_sst.op10_token_sst(spark, d).count() == 0


def test_shards_look_up(spark, tables, libraries):
    from tidemark.llm.common import shared_dir

    rows = [(i * 7 - 300, f"text number {i} " * (i % 50), "en", "s", 1) for i in range(400)]
    d = tables(documents=rows)
    out = shared_dir(spark, "sst-test")
    manifest = token_sst.write_shards(table(spark, d, "documents"), bpe_dp.vocabulary_path("byte_bpe_50k.json"), out, end_id=2)
    for i in (0, 1, 57, 399):
        found = token_sst.lookup(out, manifest, i * 7 - 300)
        assert [f.tolist() for f in found] == [[*libraries["byte_bpe_50k.json"].encode(rows[i][1], add_special_tokens=False).ids, 2]]
    assert token_sst.lookup(out, manifest, 5) == [] and token_sst.lookup(out, manifest, None) == []


def test_shard_file_blocks_and_damage():
    f = io.BytesIO()
    w = token_sst.ShardWriter(f, 2)
    rnd = random.Random(2)
    want = {}
    for i in sorted(rnd.sample(range(-(10**12), 10**12), 3000)):
        want[i] = rnd.randbytes(2 * rnd.randrange(200))
        w.add(token_sst.key_of(i), want[i])
    with pytest.raises(ValueError):
        w.add(token_sst.key_of(-(10**13)), b"")
    w.close()
    shard = token_sst.Shard(f)
    assert len(shard.places) > 3 and {token_sst.id_of(k): v for k, v in shard.scan()} == want
    assert all(shard.get(i)[0].tobytes() == v for i, v in list(want.items())[::97])
    misses = [i for i in range(2000) if i not in want]
    assert all(shard.get(i) == [] for i in misses) and sum(shard.may_hold(i) for i in misses) < 0.05 * len(misses)
    data = bytearray(f.getvalue())
    data[100] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        list(token_sst.Shard(io.BytesIO(bytes(data))).scan())


def test_a_claim_empties_the_caches_of_others():
    from tidemark.llm import near_jaccard, quality_ri
    from tidemark.llm.common import claim

    claim(near_jaccard.__name__)
    near_jaccard.shingles("one two three")
    claim(near_jaccard.__name__)
    assert near_jaccard._words
    claim(quality_ri.__name__)
    assert not near_jaccard._words and not near_jaccard._words.old
    assert len(near_jaccard.shingles("one two three")) == 1
