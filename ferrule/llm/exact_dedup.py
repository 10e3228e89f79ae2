"""Exact dedup against a minimal perfect hash of the digests seen before.

Distinct digests of the history are dealt into buckets by a part of the digest.
Each bucket gets a minimal perfect hash (levels of bit arrays with rank), whose
slots hold the full digest, the locator of the row that stays and the number of
rows.  New digests are grouped first, looked up in their bucket's table and
compared with the slot's bytes; those that are not members keep the group they
formed among themselves.

Results in odd cases: a null text counts as empty; texts of any length are read
whole; rows with equal id and text are one group of which one row stays; a null
id loses against any other; an empty table gives an empty result; other columns,
whatever their names, are passed over, or kept where documents are returned.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import arrow_map, fresh, stored, tune

#: Digests that one bucket of the index holds on average.
BUCKET_KEYS = 8192
#: Bits of a level for each key that is left; levels before the rest is held as a sorted list.
GAMMA, LEVELS = 2, 24


def _mix(keys: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit hash of each 32-byte digest, another one for each level."""
    words = keys.view("<u8").reshape(-1, 4)
    with np.errstate(over="ignore"):
        x = words[:, level % 4] ^ (words[:, (level + 1) % 4] * np.uint64(0x9E3779B97F4A7C15 + 2 * level))
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


class PerfectHash:
    """Maps n distinct 32-byte keys to 0..n-1; other keys get any slot or -1."""

    def __init__(self, bits: list[np.ndarray]):
        self.bits = bits
        ones = [int(b.sum()) for b in bits]
        self.starts = np.concatenate([[0], np.cumsum(ones)]).astype(np.int64)
        self.ranks = [np.cumsum(b) - 1 for b in bits]

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        bits, left = [], keys
        while len(left):
            if len(bits) == LEVELS:
                raise ValueError("keys are not distinct")
            at = (_mix(left, len(bits)) % np.uint64(GAMMA * len(left))).astype(np.int64)
            taken = np.bincount(at, minlength=GAMMA * len(left)) == 1
            bits.append(taken)
            left = left[~taken[at]]
        return cls(bits)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        rest = np.arange(len(keys))
        for level, taken in enumerate(self.bits):
            if not len(rest):
                break
            at = (_mix(keys[rest], level) % np.uint64(len(taken))).astype(np.int64)
            hit = taken[at]
            out[rest[hit]] = self.starts[level] + self.ranks[level][at[hit]]
            rest = rest[~hit]
        return out

    def dump(self) -> bytes:
        sizes = np.array([len(b) for b in self.bits], "<i8")
        packed = b"".join(np.packbits(b).tobytes() for b in self.bits)
        return np.array([len(sizes)], "<i8").tobytes() + sizes.tobytes() + packed

    @classmethod
    def load(cls, blob: bytes) -> PerfectHash:
        n = int(np.frombuffer(blob, "<i8", 1)[0])
        sizes, at, bits = np.frombuffer(blob, "<i8", n, 8), 8 + 8 * n, []
        for size in sizes:
            part = (int(size) + 7) // 8
            bits.append(np.unpackbits(np.frombuffer(blob, np.uint8, part, at))[:size].astype(bool))
            at += part
        return cls(bits)


def _keys(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, digests)), np.uint8).reshape(-1, 32)


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    keys = _keys(rows["digest"])
    table = PerfectHash.build(keys)
    order = np.argsort(table.slots(keys))
    return pd.DataFrame({
        "bucket": [rows["bucket"].iloc[0]], "hash": [table.dump()], "digests": [keys[order].tobytes()],
        "winners": [rows["rid"].to_numpy(np.int64)[order].tobytes()], "ids": [rows["id"].to_numpy(np.int64)[order].tobytes()],
        "known": [rows["known"].to_numpy(np.uint8)[order].tobytes()], "rows": [rows["n"].to_numpy(np.int64)[order].tobytes()],
    })


def _look_up(new: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    """What each digest's group comes to: members merge with their slot, others stay as they are."""
    if index.empty:
        return new.drop(columns="bucket").assign(member=False)
    slot = index.iloc[0]
    held = np.frombuffer(slot["digests"], np.uint8).reshape(-1, 32)
    old = pd.DataFrame({"digest": [x.tobytes() for x in held], "rid": np.frombuffer(slot["winners"], np.int64), "id": np.frombuffer(slot["ids"], np.int64), "known": np.frombuffer(slot["known"], np.uint8), "n": np.frombuffer(slot["rows"], np.int64)})
    if new.empty:
        return old.assign(member=True)
    keys = _keys(new["digest"])
    at = PerfectHash.load(slot["hash"]).slots(keys)
    hit = (at >= 0) & (held[at] == keys).all(axis=1)
    spot, mine = at[hit], new[hit]
    old = old.copy()
    both = old.loc[spot]
    # the larger (id known, id, row) of the slot and of the new group stays
    a = mine[["known", "id", "rid"]].to_numpy(np.int64)
    b = both[["known", "id", "rid"]].to_numpy(np.int64)
    later = [tuple(x) > tuple(y) for x, y in zip(a, b, strict=True)]
    best = np.where(np.array(later, bool)[:, None], a, b)
    old.loc[spot, "known"] = best[:, 0].astype(np.uint8)
    old.loc[spot, "id"] = best[:, 1]
    old.loc[spot, "rid"] = best[:, 2]
    old.loc[spot, "n"] = both["n"].to_numpy() + mine["n"].to_numpy()
    return pd.concat([old.assign(member=True), new[~hit].drop(columns="bucket").assign(member=False)], ignore_index=True)


def with_digest(docs: DataFrame, text_col: str, name: str) -> DataFrame:
    """The table with the SHA-256 of the text, A-Z in lower case, under a name that it doesn't have."""
    at = docs.columns.index(text_col)

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            lower = pc.ascii_lower(batch.column(at))
            digests = pa.array([hashlib.sha256((x or "").encode()).digest() for x in lower.to_pylist()], pa.binary())
            return pa.RecordBatch.from_arrays([*batch.columns, digests], [*batch.schema.names, name])

        return step

    return arrow_map(docs, StructType([*docs.schema.fields, StructField(name, BinaryType())]), make)


def exact_dedup(docs: DataFrame, is_history=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256, member.

    is_history is a condition on the id column (called ``id``): rows that meet
    it are indexed, the others are looked up.  Without it everything is new.
    member tells whether the digest was in the index.
    """
    tune(docs.sparkSession)
    rows = with_digest(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", "digest").select("id", "digest", F.monotonically_increasing_id().alias("rid"))
    rows = stored(rows, "digests")
    old = F.lit(False) if is_history is None else F.coalesce(is_history, F.lit(False))
    best = F.max(F.struct(F.col("id").isNotNull().cast("int").alias("known"), F.coalesce("id", F.lit(0)).cast("bigint").alias("id"), "rid"))
    grouped = rows.groupBy(old.alias("old"), "digest").agg(best.alias("b"), F.count(F.lit(1)).alias("n"))
    grouped = grouped.select("old", "digest", F.col("b.known").alias("known"), F.col("b.id").alias("id"), F.col("b.rid").alias("rid"), "n")
    grouped = stored(grouped, "digest-groups")
    buckets = max(1, -(-grouped.count() // BUCKET_KEYS))
    # another part of the digest than the perfect hash's levels mix first
    number = F.conv(F.hex(F.substring("digest", 25, 7)), 16, 10).cast("bigint")
    dealt = grouped.withColumn("bucket", F.pmod(number, F.lit(buckets)).cast("int")).select("old", "bucket", "digest", "rid", "id", "known", "n")
    index = dealt.where("old").drop("old").groupBy("bucket").applyInPandas(_build, "bucket int, hash binary, digests binary, winners binary, ids binary, known binary, rows binary")
    new = dealt.where("not old").drop("old")
    merged = new.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(_look_up, "digest binary, rid bigint, id bigint, known int, n bigint, member boolean")
    merged = merged.select("digest", F.col("rid").alias("best"), F.when(F.col("known") == 1, F.col("id")).alias("keep_id"), "n", "member")
    return rows.join(merged, "digest").select(
        F.col("id").alias(id_col), "keep_id", F.col("n").alias("group_size"), (F.col("rid") == F.col("best")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "member"
    )


def drop_copies(docs: DataFrame, is_history=None) -> DataFrame:
    """The documents that exact_dedup keeps, with all their columns.

    Documents are dealt once, by id and digest, to where their kept rows are; rows that repeat one another meet there.
    """
    digest, known, number = (fresh(docs, n) for n in ("digest", "known", "number"))
    keyed = lambda df: df.withColumns({known: F.col("doc_id").isNotNull(), number: F.coalesce("doc_id", F.lit(0))})
    kept = keyed(exact_dedup(docs, is_history).where("kept")).select(known, number, F.unhex("text_sha256").alias(digest))
    full = keyed(with_digest(docs, "text", digest))
    return full.join(kept, [digest, known, number], "left_semi").dropDuplicates([digest, known, number]).select(*[f"`{c}`" for c in docs.columns])


def op7_exact_dedup(spark, sf_dir):
    """All documents; the lower half of the ids is the history that the index holds."""
    from .common import documents

    docs = documents(spark, sf_dir)
    ends = docs.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).first()
    middle = 0 if ends["a"] is None else (ends["a"] + ends["b"]) // 2
    return exact_dedup(docs, F.col("id") <= middle)


OP7_SQL = """
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256,
                  doc_id <= (SELECT (min(doc_id) + max(doc_id)) // 2 FROM documents) AS old FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256, bool_or(old) OVER w AS member
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
