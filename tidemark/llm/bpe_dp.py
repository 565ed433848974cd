"""BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a word there is exactly one token that ends its encoding. An automaton over
the vocabulary gives, at each position, all tokens that are suffixes of the prefix; the one whose
predecessor (the stored last token of the shorter prefix) is *compatible* with it is stored, and
the ids are read off the back-pointers. Two tokens are compatible if BPE, run over their joined
symbols, would leave the boundary between them alone: that is decided by walking the two tokens'
edge symbols through the merges in rank order.

Words repeat, so results are kept in bounded caches per worker. Null texts encode as empty.
"""

from __future__ import annotations

import json
import struct
import unicodedata

import ahocorasick
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import TwoGenerations, map_batches, small_batches, table

END = "</w>"
#: One code point stands for the end-of-word suffix inside the automaton.
MARK = "\0"
#: Bytes of a generation of the words' cache: words are found again more often than whole runs.
WORD_CACHE_BYTES = 96 << 20
NEVER = 1 << 60
START = (0, -1)
SHIFT = 1_000_000


def byte_symbols() -> list[str]:
    """The printable code point that byte-level BPE writes for each byte."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(keep) else chr(next(rest)) for b in range(256)]


class PrefixBPE:
    """Exact BPE of words (strings of byte symbols), with or without an end-of-word suffix."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str | None):
        self.vocab, self.suffix = vocab, suffix
        self.strings = {i: s for s, i in vocab.items()}
        rank: dict[int, int] = {}
        self.pairs: dict[tuple[int, int], int] = {}
        parts: dict[int, tuple[int, int]] = {}
        for k, merge in enumerate(merges):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            i, j, made = vocab[a], vocab[b], vocab[a + b]
            if made in parts:
                raise ValueError(f"token {a + b!r} is made by two merges; one last token per prefix needs one")
            self.pairs[i, j], parts[made], rank[made] = k, (i, j), k
        # (token, rank of the merge that consumes it) along the right and the left edge, innermost first
        self.right: dict[int, list] = {}
        self.left: dict[int, list] = {}
        for token in vocab.values():
            for edges, side in ((self.right, 1), (self.left, 0)):
                at, path, until = token, [], NEVER
                while True:
                    path.append((at, until))
                    if at not in parts:
                        break
                    until, at = rank[at], parts[at][side]
                edges[token] = path[::-1]
        self.fits: dict[int, bool] = {}
        self.find = ahocorasick.Automaton()
        whole = set(vocab.values()) - set(rank)
        for made in sorted(rank, key=rank.__getitem__):  # a token whose own string encodes otherwise ends no encoding
            if whole.issuperset(parts[made]) and self._across(*parts[made]) == parts[made]:
                whole.add(made)
        for s, i in vocab.items():
            ends = bool(suffix) and s.endswith(suffix) and len(s) > len(suffix)
            if i in whole and (i in rank or len(s) == 1 or (ends and len(s) == len(suffix) + 1)):
                t = s[: -len(suffix)] + MARK if ends else s
                self.find.add_word(t, (len(t), i))
        self.find.make_automaton()

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE leaves the boundary between a and b alone."""
        if len(self.fits) > 500_000:
            self.fits.clear()
        got = self.fits[a * SHIFT + b] = self._across(a, b) is None
        return got

    def _across(self, a: int, b: int) -> tuple[int, int] | None:
        """The first pair that BPE merges over the boundary between a and b; None if it merges none."""
        right, left, pairs = self.right[a], self.left[b], self.pairs
        i = j = 0
        while True:
            (x, until_x), (y, until_y) = right[i], left[j]
            across = pairs.get((x, y))
            # at equal rank the leftmost pair merges first: inside a before the boundary, the boundary before inside b
            if across is not None and across < until_x and across <= until_y:
                return x, y
            if until_x == NEVER and until_y == NEVER:
                return None
            if until_x <= until_y:
                i += 1
            else:
                j += 1

    def encode(self, word: str) -> list[int]:
        """Ids of one word of byte symbols."""
        if not word:
            return []
        text = word + MARK if self.suffix else word
        bar = len(word) if self.suffix else -1  # the last symbol and its suffix are one symbol
        last: list = [None] * (len(text) + 1)
        last[0] = START
        fits, compatible = self.fits.get, self.compatible
        for end, match in self.find.iter(text):
            end += 1
            if last[end] is None and end != bar:
                before = last[end - match[0]]
                if before is START:
                    last[end] = match
                elif before is not None:
                    ok = fits(before[1] * SHIFT + match[1])
                    if compatible(before[1], match[1]) if ok is None else ok:
                        last[end] = match
        out, at = [], len(text)
        while at:
            size, token = last[at]
            out.append(token)
            at -= size
        out.reverse()
        return out


class WordTokenizer:
    """A word-level BPE file: NFC, lower case, white space dropped, an end-of-word suffix.

    ``cache[chunk]`` holds (ids as little-endian uint32, number of ids, tokens joined by spaces) of a run
    without white space: no token reaches over white space, so a text's ids are its runs' ids in order.
    """

    PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    #: These count as white space for str.split but not for the tokenizer file.
    ODD = regex.compile("[\x1c-\x1f]")
    SPACE = regex.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")

    def __init__(self, spec: dict):
        model = spec["model"]
        self.bpe = PrefixBPE(model["vocab"], model["merges"], model["end_of_word_suffix"])
        self.symbols = byte_symbols()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.words = TwoGenerations(self._word, WORD_CACHE_BYTES)
        self.cache = TwoGenerations(self._chunk)

    def _word(self, piece: str) -> tuple:
        ids = self.bpe.encode("".join(map(self.symbols.__getitem__, piece.encode())))
        return struct.pack(f"<{len(ids)}I", *ids), len(ids), " ".join(map(self.bpe.strings.__getitem__, ids))

    def _chunk(self, chunk: str) -> tuple:
        if not chunk.isascii():
            chunk = unicodedata.normalize("NFC", chunk)
            low = "".join([c.lower() for c in chunk])  # one at a time: no rule for a final sigma
        else:
            low = chunk.lower()
        if low.isalpha():
            return self.words[low]
        found = [self.words[p] for p in self.PATTERN.findall(low)]
        return b"".join([f[0] for f in found]), sum([f[1] for f in found]), " ".join([f[2] for f in found])

    def _plain(self, text: str) -> list[tuple]:
        runs = self.SPACE.split(text) if self.ODD.search(text) else text.split()
        cache = self.cache
        return [cache[r] for r in runs if r] if runs else []

    def encode(self, text: str | None) -> tuple[bytes, int, str]:
        """(ids as little-endian uint32, number of ids, decoded text)."""
        if not text:
            return b"", 0, ""
        if self.split is not None and "<|" in text and self.split.search(text):
            found = []
            for part in self.split.split(text):
                if part in self.special:
                    found.append((self.special[part].to_bytes(4, "little"), 1, part))
                else:
                    found += self._plain(part)
        else:
            found = self._plain(text)
        if not found:
            return b"", 0, ""
        ids, sizes, strings = zip(*found, strict=True)
        return b"".join(ids), sum(sizes), " ".join(strings)


_loaded: dict[str, WordTokenizer] = {}


def tokenizer(raw: bytes) -> WordTokenizer:
    """The tokenizer of a file's content; one per worker process."""
    key = f"{len(raw)}-{hash(raw)}"
    if key not in _loaded:
        _loaded[key] = WordTokenizer(json.loads(raw))
    return _loaded[key]


def encode_decode(df: DataFrame, path: str, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, then ids (binary, little-endian uint32), n_tokens and decoded of every whole text.

    The file at ``path`` is read on the driver and sent to the executors: its size is that of a
    vocabulary, not of the data. Null and empty texts give no ids and an empty decoded text. Rows
    are kept as they are, repeated ones too; further columns of ``df`` play no part.
    """
    spark = df.sparkSession
    small_batches(spark)
    with open(path, "rb") as f:
        raw = spark.sparkContext.broadcast(f.read())

    def work(batch):
        t = tokenizer(raw.value)
        found = [t.encode(x) for x in batch.column(text).to_pylist()]
        return {"ids": [f[0] for f in found], "n_tokens": [f[1] for f in found], "decoded": [f[2] for f in found]}

    schema = T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField("decoded", T.StringType())])
    return map_batches(df, keep, work, schema, [text])


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of ids and of the decoded text of every document."""
    out = encode_decode(table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"), ["doc_id"])
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
