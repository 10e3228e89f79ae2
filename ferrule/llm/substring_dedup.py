"""Removal of long byte strings that occur more than once in a corpus.

A sparse suffix array, merged in two rounds.  Of every window of MATCH bytes, the
place whose ANCHOR following bytes hash lowest is an anchor (leftmost of equals),
so two equal windows have their anchors at the same offset.

First round: each task sorts the suffixes at its anchors, as far as ANCHOR bytes,
into front-coded runs cut at common splitters; the pieces are exchanged by range
and merged with a loser tree that keeps common-prefix lengths and so never
compares a known prefix again.  Neighbours with all ANCHOR bytes in common are
repeated anchors.

Second round: the suffixes at repeated anchors, as far as a window can reach, are
sorted, front-coded, exchanged and merged in the same way, each with the bytes
before it.  The common prefixes of neighbours tell which suffixes agree for how
long; those of the bytes before, read backwards, tell the same to the left.  A
window is repeated where both agree, and the first and last repeated window
around an anchor give all bytes that it covers.

Anchors with the same surroundings are one entry that is known to repeat.  An
anchor that has over CELL different surroundings is split: each part of its
windows' offsets has more bytes in common, and only what agrees in those is
compared any further, so no task holds a common passage's surroundings all at
once.

The same is done over words (of a text with A-Z in lower case) for passages of
PASSAGE words, more than fifty, that another document has too.

Texts with equal bytes are one text from the start; where they reach MATCH bytes
they are removed whole.

Results in odd cases: a null text counts as empty; texts shorter than MATCH lose
nothing unless covered, which they can't be; null ids and repeated rows are kept
as rows, and count as occurrences; an empty table gives an empty result; other
columns, whatever their names, are passed over.
"""

from __future__ import annotations

import hashlib
import uuid
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, documents, forget, forget_path, release, scratch_path, stored, text_bytes, thinned, tune
from .words import BASE, INVERSE, WordHashes, powers

MATCH, ANCHOR = 400, 64
#: Words of a passage, and of its anchors.
PASSAGE, GRAM = 51, 8
#: Window starts handled at once, suffixes of a run, texts and anchors of each in a splitter sample.
SEGMENT, RUN, SAMPLE, EACH = 1 << 16, 200_000, 1000, 20
#: Surroundings that a task compares at once on average, those of one cell at most, parts that a larger cell's offsets are cut into.
BUCKET, CELL, PARTS = 20_000, 20_000, 8
#: Suffixes that a task sorts at once before they are exchanged.
PACK = 50_000


@dataclass(frozen=True)
class Kind:
    """What texts are sequences of: bytes of a symbol, symbols of a match and of an anchor, whether only other documents count."""

    name: str
    unit: int
    match: int
    anchor: int
    across: bool

    @property
    def left(self) -> int:
        """Symbols that a window can have before its anchor."""
        return self.match - self.anchor

    def reader(self):
        """A function that gives the symbols of a column of texts as bytes, one text after the other, and where each text begins and the last one ends."""
        words = WordHashes() if self.unit > 1 else None

        def read(column: pa.Array) -> tuple[bytes, np.ndarray]:
            texts = text_bytes(column)
            if words is None:
                data, sizes = b"".join(texts), [len(x) for x in texts]
            else:
                own, sizes = words.many(texts)
                data = own.astype(">u8").tobytes()
            return data, np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int64)

        return read


BYTES, WORDS = Kind("bytes", 1, MATCH, ANCHOR, False), Kind("words", 8, PASSAGE, GRAM, True)


def _values() -> np.ndarray:
    return np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Anchors:
    """Finds the anchors of texts."""

    def __init__(self, kind: Kind):
        self.kind, self.table = kind, _values()
        size = SEGMENT + 2 * kind.match
        self.up, self.down = powers(BASE, size), powers(INVERSE, size)

    def _numbers(self, data: bytes) -> np.ndarray:
        if self.kind.unit == 1:
            return self.table[np.frombuffer(data, np.uint8)]
        return _mix(np.frombuffer(data, ">u8").astype(np.uint64)) | np.uint64(1)

    def _segment(self, values: np.ndarray, within: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, w, size = len(values), self.kind.left + 1, self.kind.anchor
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum(values * self.down[:n], dtype=np.uint64, out=sums[1:])
        content = _mix((sums[size:] - sums[:-size]) * self.up[: n - size + 1])
        m = len(content)
        key = (content & ~np.uint64(0xFFFFF)) | np.arange(m, dtype=np.uint64)
        padded = np.full(-(-m // w) * w, np.uint64((1 << 64) - 1))
        padded[:m] = key
        blocks = padded.reshape(-1, w)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        low = np.minimum(behind[: m - w + 1], ahead[w - 1 : m])[within[: m - w + 1]]
        # the lowest place never moves back from one window to the next
        at = _once((low & np.uint64(0xFFFFF)).astype(np.int64))
        return at, content[at]

    def __call__(self, data: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places among all symbols, and 64-bit contents, of the anchors of all windows that lie in one text."""
        parts, match, unit = [], self.kind.match, self.kind.unit
        sizes = np.diff(starts)
        windows = np.maximum(sizes - match + 1, 0)
        within = np.repeat(np.tile([True, False], len(sizes)), np.stack([windows, sizes - windows], axis=1).ravel())
        for start in range(0, max(0, len(within) - match + 1), SEGMENT):
            own = within[start : start + SEGMENT]
            if own.any():
                at, content = self._segment(self._numbers(data[start * unit : (start + SEGMENT + match - 1) * unit]), own)
                parts.append((at + start, content))
        if not parts:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        at, content = (np.concatenate(x) for x in zip(*parts, strict=True))
        first = np.concatenate([[True], at[1:] != at[:-1]])
        return at[first], content[first]

    def of_suffixes(self, suffixes: list[bytes]) -> np.ndarray:
        """The 64-bit contents that anchors of these symbols have."""
        values = self._numbers(b"".join(suffixes)).reshape(len(suffixes), self.kind.anchor)
        return _mix((values * self.down[: self.kind.anchor]).sum(axis=1, dtype=np.uint64))


def _once(x: np.ndarray) -> np.ndarray:
    """Without what equals the one before it."""
    return x[np.concatenate([np.ones(min(1, len(x)), bool), x[1:] != x[:-1]])]


def shared_prefixes(items: list[bytes]) -> np.ndarray:
    """Length of the prefix that each has in common with the one before it; none for the first."""
    out = np.zeros(len(items), np.int64)
    if len(items) < 2:
        return out
    size = np.fromiter(map(len, items), np.int64, len(items))
    wide = max(8, -(-int(size.max()) // 8) * 8)
    for at in range(1, len(items), 4096):
        held = items[at - 1 : at + 4096]
        octets = np.frombuffer(b"".join([x.ljust(wide, b"\0") for x in held]), np.uint8).reshape(len(held), -1, 8)
        eights = octets.view(np.uint64)[:, :, 0]
        apart = eights[1:] != eights[:-1]
        rows, first = np.arange(len(apart)), apart.argmax(axis=1)
        inside = (octets[1:][rows, first] != octets[:-1][rows, first]).argmax(axis=1)
        out[at : at + len(apart)] = np.where(apart[rows, first], 8 * first + inside, wide)
    out[1:] = np.minimum(out[1:], np.minimum(size[1:], size[:-1]))
    return out


def front_code(items: list[tuple[bytes, int]]) -> bytes:
    """Sorted suffixes with a number each, each after the prefix that it shares with the one before: prefixes, rests, numbers, bytes."""
    suffixes = [x[0] for x in items]
    shared = shared_prefixes(suffixes)
    rest = np.array([len(x) for x in suffixes], np.int64) - shared
    numbers = np.array([x[1] for x in items], "<u4")
    return b"".join([len(items).to_bytes(4, "little"), np.array([shared, rest]).astype("<u2").tobytes(), numbers.tobytes(), *[x[h:] for x, h in zip(suffixes, shared.tolist(), strict=True)]])


def common(a: bytes, b: bytes, h: int) -> int:
    """Length of the common prefix, of which h bytes are known."""
    n = min(len(a), len(b))
    while h < n:
        x, y = a[h : h + 32], b[h : h + 32]
        if x != y:
            size = min(len(x), len(y))
            apart = int.from_bytes(x[:size]) ^ int.from_bytes(y[:size])
            return h + size - (apart.bit_length() + 7) // 8
        h += 32
    return n


def decode_run(data: bytes, base: int = 0) -> Iterator[tuple[bytes, int, int]]:
    """suffix, prefix shared with the one before, base and number."""
    n = int.from_bytes(data[:4], "little")
    shared, rests = np.frombuffer(data, "<u2", 2 * n, 4).reshape(2, n).tolist()
    numbers = np.frombuffer(data, "<u4", n, 4 + 4 * n).tolist()
    at, last = 4 + 8 * n, b""
    for h, rest, number in zip(shared, rests, numbers, strict=True):
        last = last[:h] + data[at : at + rest]
        at += rest
        yield last, h, base + number


def merge_runs(runs: list[Iterator[tuple[bytes, int, int]]]) -> Iterator[tuple[bytes, int, int]]:
    """Merged suffixes, each with the prefix that it shares with the one before, from a loser tree.

    Every loser knows how long a prefix it shares with the winner that beat it.
    A new item of the winner's run shares a known prefix with that winner too:
    the longer of the two lengths wins without looking at a byte, and only equal
    lengths are compared, from that length on.  A run at its end has length -1.
    """
    size = 1
    while size < len(runs):
        size *= 2
    heads: list[tuple[bytes, int, int] | None] = [next(r, None) for r in runs] + [None] * (size - len(runs))
    tops = [b"" if x is None else x[0] for x in heads]
    loser, length = [0] * size, [0] * size

    def compare(i: int, j: int, h: int) -> tuple[bool, int]:
        """Whether i's head comes first, and the prefix that the heads have in common, of which h bytes are known."""
        a, b = tops[i], tops[j]
        h = common(a, b, h)
        return ((len(a), i) <= (len(b), j) if h == min(len(a), len(b)) else a[h] < b[h]), h

    def build(node: int) -> tuple[int, int]:
        if node >= size:
            return node - size, -1 if heads[node - size] is None else 0
        (i, hi), (j, hj) = build(2 * node), build(2 * node + 1)
        first, length[node] = compare(i, j, hi) if hi == hj >= 0 else (hi >= hj, min(hi, hj))
        loser[node] = j if first else i
        return (i, hi) if first else (j, hj)

    i, h = build(1)
    while heads[i] is not None:
        yield tops[i], h, heads[i][2]
        heads[i] = head = next(runs[i], None)
        top, h = (b"", -1) if head is None else head[:2]
        tops[i] = top
        node = (i + size) >> 1
        while node:
            other = length[node]
            if h < other:
                loser[node], i = i, loser[node]
                length[node], h, top = h, other, tops[i]
            elif h == other and h >= 0:
                j = loser[node]
                x, y = top[h : h + 1], tops[j][h : h + 1]
                if x == y:
                    first, length[node] = compare(i, j, h)
                else:
                    first = x < y
                if not first:
                    loser[node], i, top = i, j, tops[j]
            node >>= 1


def _contents(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str, str]:
    """Rows (id, content), and the name and path of a table of the distinct texts (content, text, copies), bucketed by content."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.unhex(F.substring(F.sha2(text, 256), 1, 32)).alias("content"), text.alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = rows.groupBy("content").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    name, path = f"texts_{uuid.uuid4().hex}", scratch_path(spark, "texts")
    texts.repartition(parts, "content").write.bucketBy(parts, "content").option("path", path).option("compression", "zstd").saveAsTable(name)
    return rows.select("id", "content"), name, path


def _long(texts: DataFrame, kind: Kind) -> DataFrame:
    """Texts that can hold a match: words have a byte at least and a space between them."""
    return texts.where(f"octet_length(text) >= {kind.match if kind.unit == 1 else 2 * kind.match - 1}")


def _splitters(texts: DataFrame, kind: Kind, parts: int) -> list[bytes]:
    """Range ends from EACH anchors of about SAMPLE texts that a hash picks, whatever the number of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, read, size = Anchors(kind), kind.reader(), kind.anchor * kind.unit
        for batch in batches:
            data, starts = read(batch.column(0))
            at = anchors(data, starts)[0]
            held = [data[p : p + size] for own in np.split(at * kind.unit, np.searchsorted(at, starts[1:-1])) for p in own[:: max(1, len(own) // EACH)].tolist()]
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["suffix"])

    picked = thinned(_long(texts, kind).select("text", F.xxhash64("content").alias("o")), "o", SAMPLE)
    held = sorted(r["suffix"] for r in picked.select("text").mapInArrow(run, "suffix binary").collect())
    return sorted({held[len(held) * k // parts] for k in range(1, parts)}) if held else []


def _sorted_runs(texts: DataFrame, kind: Kind) -> DataFrame:
    """Rows of two sorts: part and run, a front-coded run of anchors with their counts; content, places and keys of a text's anchors (part is -1)."""
    ends = _splitters(texts, kind, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    fields = pa.schema([("part", pa.int32()), ("run", pa.binary()), ("content", pa.binary()), ("places", pa.list_(pa.int32())), ("keys", pa.list_(pa.int64()))])

    def cut(counts: dict[bytes, int]) -> pa.RecordBatch:
        suffixes = sorted(counts)
        at = [0, *(bisect_left(suffixes, e) for e in ends), len(suffixes)]
        rows = [{"part": k, "run": zstandard.compress(front_code([(s, counts[s]) for s in suffixes[a:b]]), 1)} for k, (a, b) in enumerate(zip(at, at[1:], strict=False)) if b > a]
        return pa.RecordBatch.from_pylist(rows, fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, read, counts, size = Anchors(kind), kind.reader(), Counter(), kind.anchor * kind.unit
        for batch in batches:
            data, starts = read(batch.column(1))
            at, own = anchors(data, starts)
            counts.update([data[p : p + size] for p in (at * kind.unit).tolist()])
            if len(counts) >= RUN:
                yield cut(counts)
                counts = Counter()
            n, each = batch.num_rows, pa.array(np.searchsorted(at, starts).astype(np.int32))
            places = (at - starts[np.searchsorted(starts, at, "right") - 1]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(each, pa.array(x)) for x in (places, own.view(np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, -1, np.int32)), pa.nulls(n, pa.binary()), batch.column(0), *lists], schema=fields)
        if counts:
            yield cut(counts)

    tune(texts.sparkSession)
    return _long(texts, kind).select("content", "text").mapInArrow(run, "part int, run binary, content binary, places array<int>, keys array<bigint>")


def repeated_anchors(runs: DataFrame, kind: Kind) -> DataFrame:
    """key: 64-bit contents of the anchors that occur at least twice; neighbours in the merged order that have all in common."""
    size = kind.anchor * kind.unit

    def merge(table):
        found, last, times = [], None, 0
        for suffix, h, count in merge_runs([decode_run(zstandard.decompress(x)) for x in table.column("run").to_pylist()]):
            if h == size:
                times += count
            else:
                if times > 1:
                    found.append(last)
                last, times = suffix, count
        if times > 1:
            found.append(last)
        return pa.table({"key": pa.array(Anchors(kind).of_suffixes(found).view(np.int64), pa.int64())})

    return runs.where("part >= 0").select("part", "run").groupBy("part").applyInArrow(merge, "key bigint")


def _digest(data: bytes, mark: int, size: int) -> bytes:
    return hashlib.blake2b(data, digest_size=size, salt=mark.to_bytes(4, "little")).digest()


def _listed(column: pa.ListArray) -> tuple[np.ndarray, pa.StructArray]:
    """The row of each item of a column of lists, and the items; a null list has none."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), sizes), column.flatten()


def _entries(texts: DataFrame, asked: DataFrame, kind: Kind) -> DataFrame:
    """What asked, with content, place, x, y, cell, lists: each place's cell, surroundings and the offsets from x to y that its text has.

    The surroundings are all bytes of windows with offsets x to y.  A null cell
    is made from the bytes that all these windows have in common.
    """
    names = ["content", "place", "x", "y", "cell", "whole", "least", "most"]

    def make():
        read, unit, match = kind.reader(), kind.unit, kind.match

        def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            data, starts = read(batch.column(1))
            row, found = _listed(batch.column(2))
            p, x, y = (found.field(k).to_numpy().astype(np.int64) for k in ("place", "x", "y"))
            n = np.diff(starts)[row]
            least, most = np.maximum(x, match - (n - p)), np.minimum(y, p)
            good = np.flatnonzero(least <= most)
            if not len(good):
                return None
            row, p, x, y, n, least, most = (v[good] for v in (row, p, x, y, n, least, most))
            cell, base = found.field("cell").take(pa.array(good)), starts[row]
            if cell.null_count:
                cells = cell.to_pylist()
                for k in np.flatnonzero(cell.is_null().to_numpy(zero_copy_only=False)).tolist():
                    a, b = (base[k] + p[k] - x[k]) * unit, (base[k] + p[k] + match - y[k]) * unit
                    cells[k] = int.from_bytes(_digest(data[a:b], int(x[k]), 8), "little", signed=True)
                cell = pa.array(cells, pa.int64())
            # bytes before the anchor, then all: where the text ends tells surroundings apart
            a, b = np.maximum(0, p - y), np.minimum(n, p + match - x)
            marks = ((p - a) * 1024 + y).tolist()
            whole = [_digest(data[i:j], mark, 16) for i, j, mark in zip(((base + a) * unit).tolist(), ((base + b) * unit).tolist(), marks, strict=True)]
            place, x, y, least, most = (pa.array(v.astype(np.int32)) for v in (p, x, y, least, most))
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), place, x, y, cell, pa.array(whole, pa.binary()), least, most], names)

        return step

    listed = asked.groupBy("content").agg(F.collect_list(F.struct("place", "x", "y", "cell")).alias("found"))
    return arrow_map(texts.select("content", "text").join(listed, "content"), "content binary, place int, x int, y int, cell bigint, whole binary, least int, most int", make)


def _packed(texts: DataFrame, entries: DataFrame, kind: Kind, buckets: int) -> DataFrame:
    """bucket and a packed, front-coded run of the suffixes at the entries' places with what is before them."""

    digests = ["content", "lo", "hi"] if kind.across else ["content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, unit, match = kind.reader(), kind.unit, kind.match
        suffixes, before, held = [], [], []

        def cut() -> pa.RecordBatch:
            numbers, dealt = np.concatenate([x[0] for x in held], axis=1), np.concatenate([x[1] for x in held])
            told = [np.concatenate(x) for x in zip(*(x[2] for x in held), strict=True)]
            rows, order = [], np.argsort(dealt, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(dealt[order])) + 1):
                own = sorted(own.tolist(), key=suffixes.__getitem__)
                code = front_code([(suffixes[i], k) for k, i in enumerate(own)])
                blob = [len(own).to_bytes(8, "little"), numbers[:, own].tobytes(), *(x[own].tobytes() for x in told), *[before[i] for i in own], code]
                rows.append((int(dealt[own[0]]), zstandard.compress(b"".join(blob), 3)))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "data"])

        for batch in batches:
            data, starts = read(batch.column(1))
            row, found = _listed(batch.column(2))
            p, x, y, least, most, known = (found.field(k).to_numpy().astype(np.int64) for k in ("place", "x", "y", "least", "most", "known"))
            first, a = starts[row] + p, np.maximum(0, p - y)
            at, begin = (first * unit).tolist(), ((starts[row] + a) * unit).tolist()
            suffixes += [data[i:j] for i, j in zip(at, (np.minimum(first + match - x, starts[row + 1]) * unit).tolist(), strict=True)]
            before += [data[i:j] for i, j in zip(begin, at, strict=True)]
            told = [batch.column(0).take(pa.array(row)), *(found.field(k) for k in digests[1:])]
            held.append((np.array([p, least, most, (p - a) * unit, known]).astype("<i4"), found.field("cell").to_numpy() % buckets, [np.frombuffer(b"".join(x.to_pylist()), "V16") for x in told]))
            if len(suffixes) >= PACK:
                yield cut()
                suffixes, before, held = [], [], []
        if suffixes:
            yield cut()

    tune(texts.sparkSession)
    listed = entries.groupBy("content").agg(F.collect_list(F.struct("place", "x", "y", "cell", *digests[1:], "least", "most", "known")).alias("found"))
    return texts.select("content", "text").join(listed, "content").mapInArrow(run, "bucket int, data binary")


def _unpacked(blobs: list[bytes], told: int) -> tuple[np.ndarray, np.ndarray, list[bytes], list]:
    """As many digests as told (content, lo, hi) and numbers (place, least, most, bytes before, known) of each entry, what is before it, and the runs."""
    digests, numbers, before, runs, base = [], [], [], [], 0
    for blob in blobs:
        data = zstandard.decompress(blob)
        n = int.from_bytes(data[:8], "little")
        numbers.append(np.frombuffer(data, "<i4", 5 * n, 8).reshape(5, n))
        at = 8 + 20 * n
        digests.append(np.frombuffer(data, "V16", told * n, at).reshape(told, n))
        at += 16 * told * n
        for size in numbers[-1][3].tolist():
            before.append(data[at : at + size])
            at += size
        runs.append(decode_run(data[at:], base))
        base += n
    return np.concatenate(digests, axis=1), np.concatenate(numbers, axis=1), before, runs


def _classes_before(before: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The order of what is before the anchors, read backwards, and the bytes that each has in common with the one before it in that order."""
    back = [b[::-1] for b in before]
    order = sorted(range(len(back)), key=back.__getitem__)
    return np.array(order), shared_prefixes([back[k] for k in order])


def _compare(kind: Kind):
    """content, first, end: symbols that repeated windows around each anchor cover, from the merged order of the suffixes."""

    def compare(table):
        digests, numbers, before, runs = _unpacked(table.column("data").to_pylist(), 3 if kind.across else 1)
        order, shared = [], []
        for _, h, number in merge_runs(runs):
            order.append(number)
            shared.append(h)
        m = len(order)
        order, shared = np.array(order), np.array(shared) // kind.unit
        digests, numbers = digests[:, order], numbers[:, order]
        place, least, most, _, known = numbers
        back, shared_back = _classes_before([before[k] for k in order.tolist()])
        shared_back //= kind.unit
        if kind.across:
            held = np.unique(digests[1:], return_inverse=True)[1].reshape(2, m)
        else:
            # any two entries of a cell are two places; a known one repeats already
            held = np.stack([np.arange(m), np.arange(m)])
        lo, hi = held
        last, first = np.full(m, -1), np.full(m, kind.match)
        before_class, paired = np.empty(m, np.int64), np.empty(m, bool)
        for offset in range(int(least.min()), int(most.max()) + 1):
            # only what agrees with a neighbour to both sides can agree with another entry
            after, ahead = shared >= kind.match - offset, shared_back >= offset
            after[0] = ahead[0] = False
            paired[back] = ahead | np.append(ahead[1:], False)
            ok = np.flatnonzero(paired & (after | np.append(after[1:], False)) & (least <= offset) & (offset <= most))
            if len(ok) < 2:
                continue
            after_class = np.cumsum(~after)
            before_class[back] = np.cumsum(~ahead)
            code = after_class[ok] * (m + 1) + before_class[ok]
            at = np.argsort(code, kind="stable")
            code = code[at]
            starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            several = np.minimum.reduceat(lo[ok][at], starts) != np.maximum.reduceat(hi[ok][at], starts)
            hit = ok[at][np.repeat(several, np.diff(np.append(starts, len(code))))]
            last[hit] = offset
            first[hit] = np.minimum(first[hit], offset)
        good = np.flatnonzero((last >= 0) & (known == 0))
        content = [x.tobytes() for x in digests[0][good]]
        return pa.table({"content": pa.array(content, pa.binary()), "first": pa.array((place[good] - last[good]).astype(np.int64)), "end": pa.array((place[good] - first[good] + kind.match).astype(np.int64))})

    return compare


def covered_spans(texts: DataFrame, kind: Kind) -> DataFrame:
    """content, first, end: symbols of each text that repeated windows cover, a span for each anchor among them."""
    spark, scratch = texts.sparkSession, Scratch()
    keep = lambda df, name, narrow=True: scratch(df, f"{kind.name}-{name}", narrow)

    runs = keep(_sorted_runs(texts, kind), "sorted-runs", narrow=False)
    keys = keep(repeated_anchors(runs, kind), "repeated-anchors", narrow=False)
    anchors = runs.where("part < 0").select("content", F.explode(F.arrays_zip("places", "keys")).alias("a")).select("content", F.col("a.places").alias("place"), F.col("a.keys").alias("cell"))
    asked = keep(anchors.join(keys.withColumnRenamed("key", "cell"), "cell").select("content", "place", F.lit(0).alias("x"), F.lit(kind.left).alias("y"), "cell"), "candidates")
    found, holders = [], ["lo", "hi"] if kind.across else []
    while True:
        entries = keep(_entries(texts, asked, kind), "entries", narrow=False)
        # places that are the same in all that is around them
        bounds = [f("content").alias(k) for f, k in zip((F.min, F.max), holders, strict=False)]
        same = entries.groupBy("cell", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("content", "place")).alias("one"), *bounds)
        same = keep(same.withColumn("known", F.col("lo") != F.col("hi") if kind.across else F.col("n") > 1), "surroundings")
        placed = keep(entries.join(same.select("cell", "whole", "one", "known", *holders), ["cell", "whole"]).withColumn("first", F.struct("content", "place") == F.col("one")).drop("whole", "one"), "placed")
        found.append(placed.where("known").select("content", (F.col("place") - F.col("most")).cast("bigint").alias("first"), (F.col("place") - F.col("least") + kind.match).cast("bigint").alias("end")))
        # written first, so that the join below can deal out a cell with many rows
        sizes = keep(same.groupBy("cell").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "cell-sizes")
        # one place stands for those that are known, as with the others it may match in part; the others all stay
        left = placed.where("first or not known").withColumn("known", F.col("known").cast("int")).drop("first")
        left = keep(left.join(sizes, "cell"), "to-compare")
        large = (F.col("m") > CELL) & (F.col("x") < F.col("y"))
        few, many = left.where(~large), left.where(large)
        count = few.count()
        if count:
            pairs = _packed(texts, few, kind, max(1, -(-count // BUCKET))).groupBy("bucket").applyInArrow(_compare(kind), "content binary, first bigint, end bigint")
            found.append(keep(pairs, "compared", narrow=False))
        release(spark)
        if many.isEmpty():
            break
        # large cells: parts of their offsets, of which each has a cell of its own
        wide = F.ceil((F.col("y") - F.col("x") + 1) / PARTS).cast("int")
        part = many.withColumn("wide", wide).withColumn("x", F.explode(F.sequence("x", "y", "wide"))).withColumn("y", F.least("y", F.col("x") + F.col("wide") - 1))
        asked = keep(part.where("x <= most and y >= least").select("content", "place", "x", "y", F.lit(None).cast("bigint").alias("cell")).distinct(), "parts")
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    spans = stored(out.groupBy("content").agg(F.collect_list(F.struct("first", "end")).alias("spans")), f"{kind.name}-spans")
    scratch.drop()
    return spans


def _removed(first: list[int], end: list[int]) -> list[tuple[int, int]]:
    spans: list[tuple[int, int]] = []
    for a, b in sorted(zip(first, end, strict=True)):
        if spans and a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
        else:
            spans.append((a, b))
    return spans


def _spans(column: pa.ListArray) -> list[tuple[list[int], list[int]]]:
    """Where the spans of each row begin and end."""
    row, spans = _listed(column)
    first, end = (spans.field(k).to_pylist() for k in ("first", "end"))
    at = np.searchsorted(row, np.arange(len(column) + 1)).tolist()
    return [(first[a:b], end[a:b]) for a, b in zip(at, at[1:], strict=False)]


def _remaining(texts: DataFrame, covered: DataFrame, passages: DataFrame, keep: bool) -> DataFrame:
    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[tuple] = []
            for data, copies, spans, words in zip(text_bytes(batch.column(1)), batch.column(2).to_pylist(), _spans(batch.column(3)), _spans(batch.column(4)), strict=True):
                cut, told = _removed(*spans), sum(b - a for a, b in _removed(*words))
                if copies > 1:
                    if len(data) >= MATCH:
                        cut = [(0, len(data))]
                    n = len(data.split())
                    told = n if n >= PASSAGE else told
                at, kept = 0, []
                for a, b in cut:
                    kept.append(data[at:a])
                    at = b
                left = b"".join([*kept, data[at:]])
                out.append((len(data), len(data) - len(left), len(cut), hashlib.sha256(left).hexdigest(), told, left))
            size, gone, spans, digest, told, left = zip(*out, strict=True)
            arrays = [batch.column(0), *(pa.array(x, pa.int64()) for x in (size, gone, spans)), pa.array(digest, pa.string()), pa.array(told, pa.int64())]
            return pa.RecordBatch.from_arrays(arrays + [pa.array(left, pa.binary())] * keep, names + ["kept"] * keep)

        return step

    names = ["content", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated_words"]
    joined = texts.select("content", "text", "copies").join(covered, "content", "left").join(passages.withColumnRenamed("spans", "words"), "content", "left")
    return arrow_map(joined.select("content", "text", "copies", "spans", "words"), "content binary, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, n_repeated_words bigint" + ", kept binary" * keep, make)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256, n_repeated_words of each row; with keep also the bytes that are left.

    n_repeated_words counts the words in passages of PASSAGE words or more that another document has too.
    """
    spark = docs.sparkSession
    tune(spark)
    rows, name, path = _contents(docs, id_col, text_col)
    try:
        texts = spark.table(name)
        covered, passages = covered_spans(texts, BYTES), covered_spans(texts, WORDS)
        left = stored(_remaining(texts, covered, passages, keep), "remaining")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        forget_path(spark, path)
    forget(covered)
    forget(passages)
    return rows.join(left, "content").select(F.col("id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated_words", *["kept"] * keep)


def op10_substring_dedup(spark, sf_dir):
    return substring_dedup(documents(spark, sf_dir))


OP10_SQL = r"""
WITH texts AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
pieces AS (SELECT r, k, n, substr(h, 800 * k + 1, 1600) AS h FROM (SELECT r, h, len(h) // 2 AS n, unnest(range(0, len(h) // 800)) AS k FROM texts) t),
windows AS (SELECT r, 400 * k + j AS i, md5(substr(h, 2 * j + 1, 800)) AS d FROM (SELECT r, k, h, unnest(range(0, least(400, n - 400 * k - 399))) AS j FROM pieces) t),
repeated AS (SELECT r, i FROM windows WHERE d IN (SELECT d FROM windows GROUP BY d HAVING count(*) > 1)),
runs AS (SELECT r, min(i) AS a, max(i) + 400 AS b FROM (
    SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS run FROM (
        SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 400 THEN 0 ELSE 1 END AS new FROM repeated) t) u GROUP BY r, run),
gaps AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM runs),
cut AS (SELECT g.r, count(*) AS n_spans, sum(b - a) AS n_removed, concat(string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a), substr(max(h), 2 * max(b) + 1)) AS h
        FROM gaps g JOIN texts t ON t.r = g.r GROUP BY g.r),
passages AS (SELECT r, i, md5(array_to_string(w[i:i + 50], ' ')) AS d FROM (SELECT r, w, unnest(range(1, len(w) - 49)) AS i FROM texts) t),
elsewhere AS (SELECT r, i FROM passages WHERE d IN (SELECT d FROM passages GROUP BY d HAVING min(r) <> max(r))),
told AS (SELECT r, count(DISTINCT i + k) AS n FROM elsewhere, range(0, 51) AS e(k) GROUP BY r)
SELECT t.doc_id, len(t.h) // 2 AS n_bytes, coalesce(c.n_removed, 0)::BIGINT AS n_removed, coalesce(c.n_spans, 0) AS n_spans,
       CASE WHEN c.r IS NULL THEN sha256(t.text) ELSE sha256(unhex(c.h)) END AS kept_sha256, coalesce(o.n, 0) AS n_repeated_words
FROM texts t LEFT JOIN cut c ON c.r = t.r LEFT JOIN told o ON o.r = t.r
"""
