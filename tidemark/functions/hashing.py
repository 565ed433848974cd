"""Digests, keyed digests, byte layouts, and the split-block Bloom filter."""

from __future__ import annotations

import hashlib
import hmac
import struct

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ZERO_HASH = "0" * 64


def le64(col: Column) -> Column:
    """Eight little-endian bytes of a long."""
    # byte by byte: reverse() takes a binary value for text and keeps multi-byte characters together
    digits = F.lpad(F.hex(col.cast("long")), 16, "0")
    return F.unhex(F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in range(7, -1, -1)]))


def sha256(col: Column) -> Column:
    return F.sha2(col.cast("binary"), 256)


def crc32(col: Column) -> Column:
    return F.crc32(col.cast("binary"))


def to_hex(col: Column) -> Column:
    return F.lower(F.hex(col))


def from_hex(col: Column, size: int = 32) -> Column:
    """Bytes of a hex text of exactly ``size`` bytes; null otherwise."""
    return F.when(col.rlike(f"^[0-9a-fA-F]{{{2 * size}}}$"), F.unhex(col))


def entry_hash(seq: Column, ts: Column, prev_hex: Column, data_hex: Column) -> Column:
    """SHA-256 of sequence, time, previous hash and data hash: 80 bytes."""
    return F.sha2(F.concat(le64(seq), le64(ts), F.unhex(prev_hex), F.unhex(data_hex)), 256)


def hmac_sha256(key: bytes, col: Column) -> Column:
    """RFC 2104 HMAC with SHA-256, from the two nested digests."""
    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    key = key.ljust(64, b"\0")
    inner = F.lit(bytearray(b ^ 0x36 for b in key))
    outer = F.lit(bytearray(b ^ 0x5C for b in key))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, col.cast("binary")), 256))), 256)


def hkdf(secret: bytes, salt: bytes, info: bytes, size: int = 32) -> bytes:
    """RFC 5869 with SHA-256: a key is derived once, on the driver."""
    prk = hmac.new(salt or bytes(32), secret, hashlib.sha256).digest()
    out, block, i = b"", b"", 1
    while len(out) < size:
        block = hmac.new(prk, block + info + bytes([i]), hashlib.sha256).digest()
        out, i = out + block, i + 1
    return out[:size]


def pseudonymise(key: bytes, col: Column) -> Column:
    """The same pseudonym for the same value under one key; null stays null."""
    return hmac_sha256(key, col)


@F.pandas_udf(T.LongType())
def xxhash64_seed0(x: pd.Series) -> pd.Series:
    """xxHash64 with seed 0, as Parquet's Bloom filters use it, as a signed long."""
    return x.map(lambda v: None if v is None else struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(bytes(v), 0)))[0])


#: The salt of Parquet's split-block Bloom filter: fixed values.
SALT = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], np.uint32)


def bloom_blocks(expected: int, fpr: float) -> int:
    """Blocks of 256 bits for so many values at a false positive rate; a power of two."""
    bits = -8 * expected / np.log(1 - fpr**0.125)
    return 1 << max(0, int(np.ceil(np.log2(max(1.0, bits / 256)))))


def _masks(h: np.ndarray) -> np.ndarray:
    return np.uint32(1) << ((h.astype(np.uint32)[:, None] * SALT) >> np.uint32(27))


def bloom_build(df: DataFrame, column: str, blocks: int) -> DataFrame:
    """(word, bits) rows of the filter over a column's bytes: partial filters are merged by bitwise or."""

    def run(frames):
        words = np.zeros((blocks, 8), np.uint32)
        for f in frames:
            h = f["h"].dropna().to_numpy("int64").view("uint64")
            np.bitwise_or.at(words, ((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32), _masks(h & np.uint64(0xFFFFFFFF)))
        used = np.flatnonzero(words.ravel())
        yield pd.DataFrame({"word": used, "bits": words.ravel()[used].astype("int64")})

    return bloom_merge(df.select(xxhash64_seed0(F.col(column).cast("binary")).alias("h")).mapInPandas(run, "word long, bits long"))


def bloom_merge(words: DataFrame) -> DataFrame:
    return words.groupBy("word").agg(F.bit_or("bits").alias("bits"))


def bloom_probe(df: DataFrame, column: str, words: DataFrame, blocks: int) -> DataFrame:
    """Adds may_contain: false means that the value was never inserted. The filter's size is fixed by ``blocks``."""
    filled = np.zeros(blocks * 8, np.uint32)
    for w, b in words.toPandas().itertuples(index=False):  # at most 8 * blocks rows
        filled[w] = b
    held = df.sparkSession.sparkContext.broadcast(filled.reshape(blocks, 8))

    @F.pandas_udf(T.BooleanType())
    def probe(x: pd.Series) -> pd.Series:
        h = x.to_numpy("int64").view("uint64")
        block = held.value[((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)]
        return pd.Series((_masks(h & np.uint64(0xFFFFFFFF)) & ~block == 0).all(axis=1))

    return df.withColumn("may_contain", probe(xxhash64_seed0(F.col(column).cast("binary"))))


def bloom_estimated_fpr(inserted: Column, blocks: int) -> Column:
    return F.pow(1 - F.exp(F.lit(-8.0) * inserted / F.lit(256.0 * blocks)), F.lit(8.0))
