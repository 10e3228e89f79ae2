"""Sorted-string-table shards of token ids.

Documents are range-partitioned and sorted by id; each partition becomes one
file.  A file has blocks of entries whose keys share prefixes with the entry
before, then a sparse index (first key and place of each block), a Bloom filter
of the keys, and a footer of fixed size.  A lookup tests the filter, finds the
block in the index by binary search and scans that block.

    block   entries: shared u16, rest u16, length u32, key bytes, value; then crc32 u32
    index   for each block: key length u16, key, offset u64, size u32
    footer  offsets and sizes of index and filter, entries, tokens, widths, magic

Keys order as ids do (sign flipped, big-endian); a null id has a key of its own
before all others.  Rows with the same id keep one entry each, ordered by text.
A null or empty text has the end id alone; texts of any length are encoded
whole, those with special tokens' strings or over LONG characters by the library
at once.  An empty table makes no files and reads back empty; other columns,
whatever their names, are passed over.  Files have names of their own for each
attempt, so a task that is run again leaves no half file in use.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Pieces, Splitter, byte_letters, default_vocabulary
from .common import documents, kept, scratch_path, tune

#: Bytes of a block, bits and hashes of the filter for each key.
BLOCK, FILTER_BITS, FILTER_HASHES = 1 << 16, 12, 7
#: Characters of a text that are cut into pieces at once at most.
LONG = 1 << 20
ENTRY, FOOTER, MAGIC = "<HHI", "<QQQQQQI8s", b"FRLTOKN1"


class Encoder:
    """The tokenizers library with the ids of short pieces remembered."""

    def __init__(self, vocabulary: str, end: int):
        from tokenizers import Tokenizer

        self.library, self.end = Tokenizer.from_file(vocabulary), end
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.loads(self.library.to_str())
        # the split below is the one of this kind of vocabulary; others go to the library whole
        self.whole = spec["normalizer"] is not None or spec["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.dtype = "<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4"
        self.letter = "H" if self.dtype == "<u2" else "I"
        self.model, self.letters = self.library.model, dict(enumerate(byte_letters()))
        self.split, self.pieces = Splitter(), Pieces(self._piece)

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        end = np.array([self.end], self.dtype).tobytes()
        for text in texts:
            yield self.ids(text) + end

    def _library(self, text: str) -> bytes:
        ids = self.library.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}{self.letter}", *ids)

    def _piece(self, piece: str) -> bytes:
        """Of one piece, by the library's model alone, which gets the letters that stand for its bytes."""
        tokens = self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))
        return struct.pack(f"<{len(tokens)}{self.letter}", *[t.id for t in tokens])

    def ids(self, text: str) -> bytes:
        if self.whole or len(text) > LONG or any(s in text for s in self.special):
            return self._library(text)
        return b"".join(map(self.pieces.__getitem__, self.split.pattern(text).findall(text)))


def key_of(number: int | None) -> bytes:
    return b"\0" if number is None else b"\1" + struct.pack(">Q", number + (1 << 63))


def number_of(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _filter_places(key: bytes, bits: int) -> list[int]:
    a, b = xxhash.xxh3_64_intdigest(key), xxhash.xxh3_64_intdigest(key, 1) | 1
    return [(a + i * b) % bits for i in range(FILTER_HASHES)]


def open_store(path: str):
    """The file system of a path and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Writer:
    """Writes entries that come in key order."""

    def __init__(self, path: str, width: int):
        store, inner = open_store(path)
        store.create_dir(inner.rsplit("/", 1)[0], recursive=True)
        self.out, self.width = store.open_output_stream(inner), width
        self.at = self.entries = self.tokens = 0
        self.block, self.first, self.last = bytearray(), b"", b""
        self.index: list[tuple[bytes, int, int]] = []
        # two hashes of each key, 16 bytes of it
        self.keys = array("Q")

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.block:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        self.block += struct.pack(ENTRY, shared, len(key) - shared, len(value)) + key[shared:] + value
        self.last, self.entries, self.tokens = key, self.entries + 1, self.tokens + len(value) // self.width
        self.keys.append(xxhash.xxh3_64_intdigest(key))
        self.keys.append(xxhash.xxh3_64_intdigest(key, 1) | 1)
        if len(self.block) >= BLOCK:
            self.flush()

    def flush(self) -> None:
        if self.block:
            data = bytes(self.block) + struct.pack("<I", zlib.crc32(self.block))
            self.index.append((self.first, self.at, len(data)))
            self.out.write(data)
            self.at += len(data)
            self.block = bytearray()

    def close(self) -> None:
        self.flush()
        index = b"".join(struct.pack("<H", len(k)) + k + struct.pack("<QI", at, size) for k, at, size in self.index)
        bits = max(64, self.entries * FILTER_BITS)
        flags = np.zeros(bits, bool)
        # as in _filter_places, where numbers don't wrap: reduce first
        first, more = (np.frombuffer(self.keys, np.uint64).reshape(-1, 2) % np.uint64(bits)).astype(np.int64).T
        for i in range(FILTER_HASHES):
            flags[(first + i * more) % bits] = True
        bloom = np.packbits(flags).tobytes()
        self.out.write(index + bloom + struct.pack(FOOTER, self.at, len(index), self.at + len(index), bits, self.entries, self.tokens, self.width, MAGIC))
        self.out.close()


class Table:
    """Reads one file."""

    def __init__(self, path: str):
        store, inner = open_store(path)
        self.file = store.open_input_file(inner)
        size = self.file.size()
        index_at, index_size, self.bloom_at, self.bits, self.entries, self.tokens, self.width, magic = struct.unpack(FOOTER, self.file.read_at(struct.calcsize(FOOTER), size - struct.calcsize(FOOTER)))
        if magic != MAGIC:
            raise ValueError(f"not a token table: {path}")
        data, at, self.keys, self.places = self.file.read_at(index_size, index_at), 0, [], []
        while at < len(data):
            n = struct.unpack_from("<H", data, at)[0]
            self.keys.append(data[at + 2 : at + 2 + n])
            self.places.append(struct.unpack_from("<QI", data, at + 2 + n))
            at += n + 14
        self.bloom = None

    def block(self, k: int) -> Iterator[tuple[bytes, bytes]]:
        at, size = self.places[k]
        data = self.file.read_at(size, at)
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("a block is damaged")
        at, key, size = 0, b"", size - 4
        while at < size:
            shared, rest, length = struct.unpack_from(ENTRY, data, at)
            at += struct.calcsize(ENTRY)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, data[at : at + length]
            at += length

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for k in range(len(self.places)):
            yield from self.block(k)

    def may_have(self, key: bytes) -> bool:
        if self.bloom is None:
            self.bloom = self.file.read_at((self.bits + 7) // 8, self.bloom_at)
        return all(self.bloom[p >> 3] & (128 >> (p & 7)) for p in _filter_places(key, self.bits))

    def get(self, number: int | None) -> list[np.ndarray]:
        """The ids of all entries with this key."""
        key, kind = key_of(number), f"<u{self.width}"
        if not self.keys or not self.may_have(key):
            return []
        k, found = max(0, bisect_right(self.keys, key) - 1), []
        while k > 0 and self.keys[k] == key:
            k -= 1  # equal keys may begin in the block before
        while k < len(self.keys) and self.keys[k] <= key:
            found += [np.frombuffer(v, kind) for own, v in self.block(k) if own == key]
            k += 1
        return found


def write_tables(docs: DataFrame, folder: str, vocabulary: str, end: int = 2, id_col: str = "doc_id", text_col: str = "text") -> list[dict]:
    """Write the shards; returns for each, in key order: path, entries, tokens, start."""
    tune(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange("id").sortWithinPartitions("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, out, first = kept(f"encoder {vocabulary} {end}", lambda: Encoder(vocabulary, end)), None, None
        path = f"{folder}/shard-{uuid.uuid4().hex}.tok"
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for number, value in zip(ids, encode([x or "" for x in batch.column(1).to_pylist()]), strict=True):
                if out is None:
                    out, first = Writer(path, np.dtype(encode.dtype).itemsize), number
                out.add(key_of(number), value)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"path": path, "first": first, "entries": out.entries, "tokens": out.tokens}], pa.schema([("path", pa.string()), ("first", pa.int64()), ("entries", pa.int64()), ("tokens", pa.int64())]))

    # one small row for each shard
    shards = sorted((r.asDict() for r in rows.mapInArrow(run, "path string, first bigint, entries bigint, tokens bigint").collect()), key=lambda r: key_of(r["first"]))
    start = 0
    for shard in shards:
        shard["start"] = start
        start += shard["tokens"]
    return shards


def read_tables(spark, shards: list[dict], values: bool = False) -> DataFrame:
    """Read shards back: doc_id, start, n_tokens, ids_crc32, with values also the ids."""
    tune(spark)
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * values
    listed = spark.createDataFrame([(s["path"], s["start"]) for s in shards], "path string, start bigint")
    if shards:
        listed = listed.repartition(len(shards))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                table = Table(path)
                rows, held = [], 0
                for key, value in table:
                    ids = np.frombuffer(value, f"<u{table.width}")
                    row = {"doc_id": number_of(key), "start": at, "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.astype("<u4").tobytes())}
                    if values:
                        row["ids"] = ids.tolist()
                    rows.append(row)
                    at += len(ids)
                    held += len(value) if values else 32
                    if held >= 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, kind)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, kind)

    kind = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int64()))] * values)
    return listed.mapInArrow(run, schema)


def op8_token_tables(spark, sf_dir):
    shards = write_tables(documents(spark, sf_dir), scratch_path(spark, "token-tables"), default_vocabulary())
    return read_tables(spark, shards)
