"""Token ids in sorted-string-table shards.

A shard holds documents in ascending key order. Its file, from the start:

    magic | data blocks | Bloom filter | block index | footer

* data block: entries, the offsets of its restart points (uint32 each), their number (uint32), crc32.
  An entry is varint(bytes shared with the key before), varint(further key bytes), varint(value bytes),
  the further key bytes, the value. Every 16th entry shares nothing: a restart point.
* key: null marker (0 for a null id, else 1), the id as big-endian 64 bits with its sign flipped,
  64 bits of the text's hash, 32 bits that number rows equal in both. Byte order is id order.
* value: the ids, little-endian, 2 or 4 bytes each.
* Bloom filter: number of hashes (uint32), then bits; it holds the first 9 key bytes (the id).
* block index: for each block the last key (uint16 length and bytes), offset and size (uint64 each).
* footer: offsets and sizes of filter and index, rows, ids, bytes an id, magic.

``Shard.get`` asks the filter, searches the index by bisection, then the block's restart points.

Null texts are empty documents (just the end id). Null ids sort first. Repeated rows are kept, each
with its own number. An empty table gives no shard. Further columns of the table play no part.
"""

from __future__ import annotations

import bisect
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe_dp import vocabulary_path
from .common import BATCH_ROWS, make_dirs, open_store, shared_dir, small_batches, table

MAGIC = b"TDMKSST1"
FOOTER = struct.Struct("<QQQQQQI8s")
BLOCK_BYTES = 64 * 1024
RESTART_EVERY = 16
BLOOM_BITS = 10
BLOOM_HASHES = 7
ID_BYTES = 9
#: Bytes of a generation of the encoder's cache, and of an entry beside its text and ids.
CACHE_BYTES, ENTRY_BYTES = 96 << 20, 160


def key_of(doc_id: int | None, text_hash: int = 0, number: int = 0) -> bytes:
    head = b"\0" + bytes(8) if doc_id is None else b"\1" + struct.pack(">Q", (doc_id + (1 << 63)) & (1 << 64) - 1)
    return head + struct.pack(">Q", (text_hash + (1 << 63)) & (1 << 64) - 1) + struct.pack(">I", number)


def id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else struct.unpack(">Q", key[1:ID_BYTES])[0] - (1 << 63)


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def bloom_places(head: bytes, bits: int, hashes: int) -> list[int]:
    h = xxhash.xxh64_intdigest(head)
    a, b = h & 0xFFFFFFFF, h >> 32 | 1
    return [(a + i * b) % bits for i in range(hashes)]


class ShardWriter:
    """Writes entries, given in ascending key order, to a binary file object."""

    def __init__(self, out, id_width: int):
        self.out, self.id_width = out, id_width
        self.at = 0
        self.rows = self.ids = 0
        self.index: list[tuple[bytes, int, int]] = []
        self.heads: list[bytes] = []
        self.first = self.last = None
        self._new_block()
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _new_block(self) -> None:
        self.block, self.restarts, self.count = bytearray(), [], 0

    def add(self, key: bytes, value: bytes) -> None:
        if self.last is not None and key <= self.last:
            raise ValueError("keys must ascend")
        shared = 0
        if self.count % RESTART_EVERY == 0:
            self.restarts.append(len(self.block))
        else:
            shared = len(os.path.commonprefix([self.last, key]))
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.count += 1
        self.first = self.first or key
        if not self.heads or self.heads[-1] != key[:ID_BYTES]:
            self.heads.append(key[:ID_BYTES])
        self.last = key
        self.rows += 1
        self.ids += len(value) // self.id_width
        if len(self.block) >= BLOCK_BYTES:
            self._end_block()

    def _end_block(self) -> None:
        if self.count:
            body = bytes(self.block) + struct.pack(f"<{len(self.restarts)}II", *self.restarts, len(self.restarts))
            self.index.append((self.last, self.at, len(body) + 4))
            self._put(body + struct.pack("<I", zlib.crc32(body)))
            self._new_block()

    def close(self) -> None:
        self._end_block()
        bits = max(64, len(self.heads) * BLOOM_BITS + 7 & ~7)
        bloom = bytearray(bits // 8)
        for head in self.heads:
            for p in bloom_places(head, bits, BLOOM_HASHES):
                bloom[p >> 3] |= 1 << (p & 7)
        bloom_at = self.at
        self._put(struct.pack("<I", BLOOM_HASHES) + bytes(bloom))
        index_at = self.at
        self._put(b"".join(struct.pack("<H", len(k)) + k + struct.pack("<QQ", at, size) for k, at, size in self.index))
        self._put(FOOTER.pack(bloom_at, index_at - bloom_at, index_at, self.at - index_at, self.rows, self.ids, self.id_width, MAGIC))


class Shard:
    """Reads a shard from a binary file object that can seek."""

    def __init__(self, file):
        self.file = file
        file.seek(0, os.SEEK_END)
        file.seek(file.tell() - FOOTER.size)
        bloom_at, bloom_size, index_at, index_size, self.rows, self.ids, self.id_width, magic = FOOTER.unpack(file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        bloom = self._read(bloom_at, bloom_size)
        self.hashes, self.bloom = struct.unpack("<I", bloom[:4])[0], bloom[4:]
        index, at = self._read(index_at, index_size), 0
        self.last_keys, self.places = [], []
        while at < len(index):
            n = struct.unpack_from("<H", index, at)[0]
            self.last_keys.append(index[at + 2 : at + 2 + n])
            self.places.append(struct.unpack_from("<QQ", index, at + 2 + n))
            at += 18 + n

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return bytes(self.file.read(size))

    def _block(self, k: int) -> tuple[bytes, tuple[int, ...], int]:
        data = self._read(*self.places[k])
        body = data[:-4]
        if zlib.crc32(body) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError(f"block {k} is damaged")
        n = struct.unpack("<I", body[-4:])[0]
        end = len(body) - 4 - 4 * n
        return body, struct.unpack_from(f"<{n}I", body, end), end

    @staticmethod
    def _entries(body: bytes, at: int, end: int) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < end:
            shared, at = read_varint(body, at)
            more, at = read_varint(body, at)
            size, at = read_varint(body, at)
            key = key[:shared] + body[at : at + more]
            at += more
            yield key, body[at : at + size]
            at += size

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        for k in range(len(self.places)):
            body, _, end = self._block(k)
            yield from self._entries(body, 0, end)

    def may_hold(self, doc_id: int | None) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in bloom_places(key_of(doc_id)[:ID_BYTES], 8 * len(self.bloom), self.hashes))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every row with this id, in key order; an empty list if there is none."""
        if not self.may_hold(doc_id):
            return []
        head, found = key_of(doc_id)[:ID_BYTES], []
        for k in range(bisect.bisect_left(self.last_keys, head), len(self.places)):
            body, restarts, end = self._block(k)
            at = bisect.bisect_left(restarts, 1, key=lambda r: int(next(self._entries(body, r, end))[0][:ID_BYTES] >= head))
            for key, value in self._entries(body, restarts[max(0, at - 1)], end):
                if key[:ID_BYTES] == head:
                    found.append(np.frombuffer(value, f"<u{self.id_width}"))
                elif key[:ID_BYTES] > head:
                    return found
        return found


class CachedEncoder:
    """The tokenizers library, asked once for each run of text between spaces while that run is in the cache.

    A pre-token never reaches over the border between a non-space and the white space after it, nor over a
    single space that a non-space follows on both sides, so runs can be encoded alone. Texts with any other
    white space pattern, or with special tokens, go to the library whole. The cache is bounded by its bytes.
    """

    UNUSUAL = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread a task
        self.library = Tokenizer.from_str(spec)
        self.library.no_padding()
        self.library.no_truncation()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.id_width = 2 if max(self.library.get_vocab(with_added_tokens=True).values()) < 1 << 16 else 4
        self.after_space: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0

    def pack(self, ids) -> bytes:
        return np.asarray(ids, f"<u{self.id_width}").tobytes()

    def _missing(self, pieces: list[str], got: list) -> list[bytes]:
        miss = list({p for p, g in zip(pieces, got, strict=True) if g is None})
        new, look = {}, []
        for p in miss:
            if (b := self.old.get(p)) is None:
                look.append(p)
            else:
                new[p] = b
        for p, e in zip(look, self.library.encode_batch_fast([" " + p for p in look], add_special_tokens=False), strict=True):
            new[p] = self.pack(e.ids)
        if self.held > CACHE_BYTES:
            self.old, self.after_space, self.held = self.after_space, {}, 0
        self.after_space.update(new)
        self.held += ENTRY_BYTES * len(new) + sum(map(len, new)) + sum(map(len, new.values()))
        return [new[p] if g is None else g for p, g in zip(pieces, got, strict=True)]

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if "  " in text or "\n \n" in text or text[-1] == " " or self.UNUSUAL.search(text) or any(s in text for s in self.special):
            return self.pack(self.library.encode(text, add_special_tokens=False).ids)
        first, *pieces = text.split(" ")
        head = self.pack(self.library.encode(first, add_special_tokens=False).ids) if first else b""
        got = list(map(self.after_space.get, pieces))
        if None in got:
            got = self._missing(pieces, got)
        return head + b"".join(got)


_loaded: dict[str, CachedEncoder] = {}


def encoder(spec: str) -> CachedEncoder:
    key = f"{len(spec)}-{hash(spec)}"
    if key not in _loaded:
        _loaded[key] = CachedEncoder(spec)
    return _loaded[key]


def write_shards(df: DataFrame, path: str, out: str, end_id: int | None, doc_id: str = "doc_id", text: str = "text") -> list[dict]:
    """Encodes every text, writes one shard a range of ids to folder ``out``, and returns the manifest.

    The manifest has one small entry a shard, in key order: file, rows, ids, first and last key. Files get
    their names only when complete, and a task that runs again writes the same bytes.
    """
    spark = df.sparkSession
    small_batches(spark)
    with open(path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    make_dirs(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context, writer = TaskContext.get(), None
        part = context.partitionId()
        store, folder = open_store(out)
        made = f"{folder}/.shard-{part:06d}-{context.taskAttemptId()}"
        enc = encoder(spec.value)
        tail = enc.pack([end_id]) if end_id is not None else b""
        before, number = None, 0
        for batch in batches:
            for d, h, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if writer is None:
                    file = store.open_output_stream(made)
                    writer = ShardWriter(file, enc.id_width)
                number = number + 1 if (d, h) == before else 0
                before = (d, h)
                writer.add(key_of(d, h, number), enc.encode(x) + tail)
        if writer is not None:
            writer.close()
            file.close()
            name = f"shard-{part:06d}.sst"
            store.move(made, f"{folder}/{name}")
            yield pa.RecordBatch.from_pydict({"file": [name], "rows": [writer.rows], "ids": [writer.ids], "first_key": [writer.first], "last_key": [writer.last]})

    rows = df.select(F.col(doc_id).cast("long").alias("d"), F.xxhash64(text).alias("h"), F.col(text).alias("x"))
    shards = rows.repartitionByRange("d", "h").sortWithinPartitions("d", "h", "x").mapInArrow(run, "file string, rows long, ids long, first_key binary, last_key binary")
    return sorted((r.asDict() for r in shards.collect()), key=lambda r: bytes(r["first_key"]))


def read_shards(spark: SparkSession, out: str, manifest: list[dict]) -> DataFrame:
    """doc_id, start (ids before it, over all shards), n_tokens and ids (binary, little-endian uint32) from the files."""
    start, rows = 0, []
    for m in manifest:
        rows.append((m["file"], start))
        start += m["ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = open_store(out)
        for batch in batches:
            for name, at in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True):
                with store.open_input_file(f"{folder}/{name}") as file:
                    shard = Shard(file)
                    held: list[tuple] = []
                    for key, value in shard.scan():
                        n = len(value) // shard.id_width
                        held.append((id_of(key), at, n, value if shard.id_width == 4 else np.frombuffer(value, "<u2").astype("<u4").tobytes()))
                        at += n
                        if len(held) >= BATCH_ROWS:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), TYPES, strict=True)], NAMES)
                            held = []
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), TYPES, strict=True)], NAMES)

    listed = spark.createDataFrame(rows, "file string, start long")
    return listed.repartition(max(1, len(rows)), "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
NAMES = ["doc_id", "start", "n_tokens", "ids"]


def lookup(out: str, manifest: list[dict], doc_id: int | None) -> list[np.ndarray]:
    """Ids of the rows with this id: only shards whose key range can hold it are opened."""
    store, folder = open_store(out)
    head, found = key_of(doc_id)[:ID_BYTES], []
    for m in manifest:
        if bytes(m["first_key"])[:ID_BYTES] <= head <= bytes(m["last_key"])[:ID_BYTES]:
            with store.open_input_file(f"{folder}/{m['file']}") as file:
                found += Shard(file).get(doc_id)
    return found


def op10_token_sst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts, places and checksums of every document, read back from the shards."""
    out = shared_dir(spark, "token-sst")
    manifest = write_shards(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"), out, end_id=2)
    return read_shards(spark, out, manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
