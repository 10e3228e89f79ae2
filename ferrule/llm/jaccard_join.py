"""Similarity join on word shingles with PartEnum signatures.

Sets whose sizes can meet the threshold lie in the same or in neighbouring size
bands.  For each pair of neighbouring bands, two sets that are similar enough
differ in at most k features.  The feature domain is cut into n1 parts of PARTS
parts each; some first-level part holds at most PARTS - SUBSET differences, so
one of its subsets of SUBSET second-level parts is equal in both.  Each subset's
content is a signature.

Features that many documents share (found on a sample) take no part at first:
outside them, too, similar sets differ in at most k features, whatever they are.
Signatures of fewer than STRONG features are left out; a set that has too few
strong ones for the rule above to hold gets signatures of all its features
besides, weak ones too if need be.  Two such sets share one of those, any other
pair one of the first sort.

Members of a run whose sizes and feature counts rule out similarity are parted
first (runs over LARGE go on whole).  Sets sharing a signature are then compared
with the smallest id of the run, and where that leaves a run in several
components, with other pivots (stars, not all pairs).  What is still apart then
is compared with the sets that its runs tie it to, block by block: no task holds
more than two blocks, and sets of the largest component of such a cluster are
not compared with each other.  Every comparison is of whole sets; no link is
lost.

Results in odd cases: null and empty texts, and texts without words, have empty
sets and stay alone; equal sets are one node; a text of fewer words than a
shingle is one shingle; rows with a null id come back with a null component;
rows that repeat an id are one node; an empty table gives an empty result; other
columns are passed over.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, documents, forget, fresh, release, stored, text_bytes, thinned, tune
from .components import components
from .words import WordHashes, mix

#: Features that a signature should have, second-level parts and those of a subset, growth of the number of parts that makes up for weak ones.
STRONG, PARTS, SUBSET, SPARE = 1, 3, 2, 1.1
#: Groups of equal sets with more than this share of the rows are one row from the start; at most 1 / HOT of them exist.
HOT = 0.001
#: Documents that tell which features are common, the share of them that has one, and how many at least: at most 1 / COMMON of an average set.
SAMPLE, COMMON, LEAST = 2000, 0.01, 20
#: Signatures that one bucket of the exchange holds on average; bits of a signature beyond those that its bucket tells.
BUCKET_SIGS, BITS = 1_000_000, 48
#: Members of a run that one task parts; sets of a block; rounds of pivots.
LARGE, BLOCK, PIVOTS = 4096, 256, 2
K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _hashed(words: np.ndarray, span: int) -> np.ndarray:
    """Hashes of the runs of so many words."""
    x = np.full(max(0, len(words) - span + 1), np.uint64(span))
    for i in range(span):
        x ^= words[i : len(x) + i]
        x *= K[0]
        x ^= x >> np.uint64(31)
    return mix(x)


def shingle_sets(words: np.ndarray, sizes: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of each text; words has those of all texts, sizes how many each has."""
    every, out, at = _hashed(words, width), [], 0
    for n in sizes.tolist():
        x = every[at : at + n - width + 1] if n >= width else _hashed(words[at : at + n], n) if n else every[:0]
        at += n
        if len(x) > 1:
            x = np.sort(x)
            new = np.empty(len(x), bool)
            new[0] = True
            np.not_equal(x[1:], x[:-1], out=new[1:])
            x = x[new]
        out.append(x)
    return out


def _sets_of(column: pa.Array, width: int, words: WordHashes) -> list[np.ndarray]:
    return shingle_sets(*words.many(text_bytes(column)), width)


class Bands:
    """Size bands of a threshold of num / den and the differences that neighbours may have."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.tops = num, den, [0]

    def of(self, size: int) -> int:
        while self.tops[-1] < size:
            self._add()
        return bisect_left(self.tops, size)

    def _add(self) -> None:
        self.tops.append((self.tops[-1] + 1) * self.den // self.num)

    def differences(self, band: int) -> int:
        """Most differing features of similar sets in this band and the one before."""
        while band >= len(self.tops):
            self._add()
        return 2 * self.tops[band] * (self.den - self.num) // (self.den + self.num)


def _weighed(features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What deals features to parts, and what is summed there: equal contents are summed in the same order to the same number."""
    return features >> np.uint64(32), (mix(features ^ K[2]) >> np.uint64(12)).astype(np.float64)


CHOSEN = np.array(list(combinations(range(PARTS), SUBSET)))


def _subsets(weighed: tuple[np.ndarray, np.ndarray], n1: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """For each subset of second-level parts (rows) and each first-level part: the content's hash and how many features it has."""
    high, weight = weighed
    cells = n1 * PARTS
    cell = ((high * np.uint64(cells)) >> np.uint64(32)).astype(np.int64)
    count = np.bincount(cell, minlength=cells).reshape(n1, PARTS)
    # the second-level parts of a subset are told apart by their features
    sums = np.bincount(cell, weight, cells).view(np.uint64).reshape(n1, PARTS) * K[1]
    made = np.arange(n1, dtype=np.uint64) + (np.uint64(salt << 36) + (np.arange(len(CHOSEN), dtype=np.uint64) << np.uint64(30)))[:, None]
    made *= K[0]
    sizes = np.zeros(made.shape, np.int64)
    for parts in CHOSEN.T:
        made += sums[:, parts].T
        sizes += count[:, parts].T
    return mix(made), sizes


def signatures(features: np.ndarray, bands: Bands, common: np.ndarray) -> np.ndarray:
    """PartEnum signatures of a set for its band with the one before and with the one after; common has the sorted common features."""
    out, size = [], len(features)
    rare = features
    if len(common):
        at = np.minimum(np.searchsorted(common, features), len(common) - 1)
        rare = features[common[at] != features]
    band = bands.of(size)
    k2 = PARTS - SUBSET
    rare, every = _weighed(rare), None
    for pair in (band, band + 1):
        k = bands.differences(pair)
        if not k:
            continue  # only equal sets are similar
        n1 = int(-(-(k + 1) * SPARE // (k2 + 1))) + 1

        def told(sizes: np.ndarray, k=k) -> tuple[np.ndarray, bool]:
            """Which signatures are strong, and whether first-level parts with strong ones only are enough for one of at most k2 differences."""
            strong = sizes >= STRONG
            return strong, int(strong.all(axis=0).sum()) * (k2 + 1) > k

        made, sizes = _subsets(rare, n1, 2 * pair)
        strong, safe = told(sizes)
        out.append(made[strong])
        if not safe:
            every = every or (rare if len(rare[0]) == size else _weighed(features))
            made, sizes = _subsets(every, n1, 2 * pair + 1)
            strong, safe = told(sizes)
            out.append(made[strong] if safe else made.ravel())
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def common_features(docs: DataFrame, width: int) -> np.ndarray:
    """Sorted features that COMMON of a sample of about SAMPLE documents have, LEAST of them at least; any choice gives the same links."""

    def make():
        words = WordHashes()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [x.view(np.int64) for x in _sets_of(batch.column(0), width, words)]
            return pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int64()))], ["features"])

        return step

    picked = thinned(docs.where("id is not null").select("text", F.xxhash64("id").alias("o")), "o", SAMPLE)
    sets = stored(arrow_map(picked.select("text"), "features array<bigint>", make), "sample-sets")
    least = max(LEAST, int(COMMON * sets.count()))
    table = sets.select(F.explode("features").alias("f")).groupBy("f").count().where(F.col("count") >= least).select("f").toArrow()
    forget(sets)
    return np.sort(table["f"].to_numpy().view(np.uint64))


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """id, number of features, a 128-bit key of the set, and its features counted by their first bits."""

    def make():
        words = WordHashes()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, a, b, c = [], [], [], []
            for found in _sets_of(batch.column(1), width, words):
                n.append(len(found))
                a.append(int(found.sum(dtype=np.uint64)))
                b.append(int(mix(found ^ K[0]).sum(dtype=np.uint64)))
                c.append(nibbles(sketch_of(found, sketch_bits(len(found)))))
            keys = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, b)]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *keys, pa.array(c, pa.binary())], ["id", "n", "k1", "k2", "sketch"])

        return step

    return arrow_map(docs, "id bigint, n bigint, k1 bigint, k2 bigint, sketch binary", make)


def _packed(docs: DataFrame, width: int, num: int, den: int, hot: dict[tuple, int], common: np.ndarray, buckets: int) -> DataFrame:
    """Sorted signatures with ids as bytes, one row for each bucket and batch."""
    shared = docs.sparkSession.sparkContext.broadcast(common)
    starts = [b * (1 << 64) // buckets for b in range(buckets)]
    shift = max(0, 64 - (buckets.bit_length() - 1) - BITS)

    def make():
        words, bands, common = WordHashes(), Bands(num, den), shared.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sigs, ids = [], []
            for own, found in zip(batch.column(0).to_pylist(), _sets_of(batch.column(1), width, words), strict=True):
                if own is None or not len(found):
                    continue
                if hot and hot.get((len(found), int(found.sum(dtype=np.uint64)), int(mix(found ^ K[0]).sum(dtype=np.uint64))), own) != own:
                    continue
                s = signatures(found, bands, common)
                sigs.append(s)
                ids.append(np.full(len(s), own, np.int64))
            if not sigs:
                return None
            s, i = np.concatenate(sigs), np.concatenate(ids)
            order = np.argsort(s)
            s, i = s[order], i[order]
            # buckets are ranges of the signature, so each one is a slice
            ends = [*map(int, np.searchsorted(s, np.array(starts, np.uint64))), len(s)]
            rows = [(b, _pack((s[x:y] - np.uint64(starts[b])) >> np.uint64(shift), i[x:y])) for b, (x, y) in enumerate(zip(ends, ends[1:], strict=False)) if y > x]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "data"])

        return step

    return arrow_map(docs, "bucket int, data binary", make)


def _pack(sigs: np.ndarray, ids: np.ndarray) -> bytes:
    """Count, smallest id and width of the offsets, then the lowest BITS of the signatures (they have no more), and offsets."""
    low = int(ids.min())
    wide = int(ids.max()) - low >= 1 << 32
    head = np.array([len(sigs), low, wide], "<i8").tobytes()
    return head + sigs.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : BITS // 8].tobytes() + (ids - low).astype("<u8" if wide else "<u4").tobytes()


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, low, wide = map(int, np.frombuffer(data, "<i8", 3))
    sigs = np.zeros((n, 8), np.uint8)
    sigs[:, : BITS // 8] = np.frombuffer(data, np.uint8, n * BITS // 8, 24).reshape(n, -1)
    return sigs.reshape(-1).view("<u8"), np.frombuffer(data, "<u8" if wide else "<u4", n, 24 + n * BITS // 8).astype(np.int64) + low


def _runs(packed: DataFrame) -> DataFrame:
    """run, first, id: the members of each signature that several ids share."""

    def run(table):
        parts = [_unpack(x) for x in table.column("data").to_pylist()]
        s, i = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        order = np.argsort(s)
        s, i = s[order], i[order]
        starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        sizes = np.diff(np.append(starts, len(s)))
        starts, sizes = starts[sizes > 1], sizes[sizes > 1]
        member = i[np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64), sizes) + np.arange(int(sizes.sum()))] if len(starts) else i[:0]
        ends = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if len(starts) else starts
        first = np.repeat(np.minimum.reduceat(member, ends), sizes) if len(starts) else member
        # runs with the same members are the same run
        name = np.repeat(np.add.reduceat(mix(member.view(np.uint64) ^ K[1]), ends).view(np.int64), sizes) if len(starts) else member
        order = np.lexsort((member, name))
        name, first, member = name[order], first[order], member[order]
        once = np.ones(len(name), bool)
        once[1:] = (name[1:] != name[:-1]) | (member[1:] != member[:-1])
        return pa.table({"run": name[once], "first": first[once], "id": member[once]})

    return packed.groupBy("bucket").applyInArrow(run, "run bigint, first bigint, id bigint")


def sketch_bits(size: int) -> int:
    """First bits by which a set's features are counted: about three features for each count."""
    return min(14, max(6, (size // 3).bit_length()))


def sketch_of(features: np.ndarray, bits: int) -> np.ndarray:
    """Features counted by their first bits, up to 15; no fewer features differ between sets than counts do."""
    return np.minimum(np.bincount((features >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 15).astype(np.uint8)


def nibbles(counts: np.ndarray) -> bytes:
    return (counts[::2] | counts[1::2] << 4).tobytes()


def counts_of(data: bytes) -> np.ndarray:
    packed = np.frombuffer(data, np.uint8)
    out = np.empty(2 * len(packed), np.uint8)
    out[::2], out[1::2] = packed & 15, packed >> 4
    return out


def _folded(sketches: list[np.ndarray]) -> np.ndarray:
    """Sketches as rows of the shortest one's length."""
    width = min(len(x) for x in sketches)
    rows = [x if len(x) == width else np.minimum(x.reshape(width, -1).sum(axis=1), 15) for x in sketches]
    return np.array(rows, np.int16)


def _near(size: np.ndarray, sketch: np.ndarray, x: int, y: np.ndarray, num: int, den: int) -> np.ndarray:
    """Those of y whose sizes and counts let them be similar to x; none that is similar is left out."""
    y = y[den * np.minimum(size[y], size[x]) >= num * np.maximum(size[y], size[x])]
    apart = np.abs(sketch[y] - sketch[x]).sum(axis=1)
    return y[(den + num) * apart <= (den - num) * (size[y] + size[x])]


def _split_runs(num: int, den: int):
    """Runs cut into the parts whose members can be similar to each other; the rest goes."""

    def split(table):
        run, ids, size = (table.column(c).to_numpy() for c in ("run", "id", "n"))
        sketches = [counts_of(x) for x in table.column("sketch").to_pylist()]
        order = np.lexsort((ids, run))
        run, ids, size, sketches = run[order], ids[order], size[order], [sketches[k] for k in order.tolist()]
        starts = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
        counts = np.diff(np.append(starts, len(run)))
        group = np.arange(len(run))
        two = starts[counts == 2]
        two = two[den * np.minimum(size[two], size[two + 1]) >= num * np.maximum(size[two], size[two + 1])]
        for at in two.tolist():
            a, b = sketches[at], sketches[at + 1]
            if len(a) != len(b):
                a, b = _folded([a, b])
            apart = int(np.abs(a.astype(np.int16) - b).sum())
            if (den + num) * apart <= (den - num) * int(size[at] + size[at + 1]):
                group[at + 1] = at
        for start, count in zip(starts[counts > 2].tolist(), counts[counts > 2].tolist(), strict=True):
            own, lengths, left = _folded(sketches[start : start + count]), size[start : start + count], np.arange(count)
            while len(left):
                # everything that can be reached from the first one that is left
                queue, left = [int(left[0])], left[1:]
                name = queue[0]
                while queue and len(left):
                    found = _near(lengths, own, queue.pop(), left, num, den)
                    group[start + found] = start + name
                    queue += found.tolist()
                    left = left[~np.isin(left, found, assume_unique=True)]
        names, place, many = np.unique(group, return_inverse=True, return_counts=True)
        keep = many[place] > 1
        with np.errstate(over="ignore"):
            content = np.zeros(len(names), np.uint64)
            np.add.at(content, place, mix(ids.view(np.uint64) ^ K[1]))
        return pa.table({"run": content[place][keep].view(np.int64), "first": ids[group][keep], "id": ids[keep]})

    return split


def _full_sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    def make():
        words = WordHashes()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [x.view(np.int64) for x in _sets_of(batch.column(1), width, words)]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["id", "features"])

        return step

    return arrow_map(docs.join(ids, "id", "left_semi"), "id bigint, features array<bigint>", make)


def _similar(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return den * both >= num * (len(a) + len(b) - both)


class Compared:
    """Sets held together, which of them are linked, and which pairs were compared."""

    def __init__(self, ids, features, component, num: int, den: int):
        self.ids, self.num, self.den = np.asarray(ids), num, den
        self.sets = [np.asarray(x).view(np.uint64) for x in features]
        self.size = np.array([len(x) for x in self.sets], np.int64)
        bits = sketch_bits(int(self.size.min())) if len(self.sets) else 6
        self.sketch = np.array([sketch_of(x, bits) for x in self.sets], np.int16)
        self.root = np.unique(component, return_inverse=True)[1]
        self.links: list[tuple] = []

    def against(self, x: int, others: np.ndarray) -> None:
        """Compare set x with others that it isn't linked with yet."""
        num, den, size = self.num, self.den, self.size
        near = _near(size, self.sketch, x, others[self.root[others] != self.root[x]], num, den)
        for y in near.tolist():
            if self.root[y] != self.root[x] and _similar(self.sets[x], self.sets[y], num, den):
                self.root[self.root == self.root[y]] = self.root[x]
                self.links.append((self.ids[x], self.ids[y]))

    def frame(self) -> pd.DataFrame:
        return pd.DataFrame(self.links, columns=["a", "b"])


def _block_links(num: int, den: int):
    """Links of a block of sets that are apart with a block of their cluster."""

    def compare(key, rows: pd.DataFrame) -> pd.DataFrame:
        held = Compared(rows["id"], rows["features"], rows["component"], num, den)
        asks, apart = rows["asks"].to_numpy(), rows["apart"].to_numpy()
        there = np.flatnonzero(~asks)
        for x in np.flatnonzero(asks).tolist():
            # two that are both apart meet twice; once is enough
            own = held.ids[there]
            held.against(x, there[(own != held.ids[x]) & (~apart[there] | (own > held.ids[x]))])
        return held.frame()

    return compare


def _verified(pairs: DataFrame, full: DataFrame, num: int, den: int) -> DataFrame:
    """a, b: the pairs (first, id) whose sets are similar."""
    both = F.size(F.array_intersect("f1", "f2")).cast("bigint")
    return (
        pairs.join(full.select(F.col("id").alias("first"), F.col("features").alias("f1")), "first")
        .join(full.select("id", F.col("features").alias("f2")), "id")
        .where(den * both >= num * (F.size("f1") + F.size("f2") - both))
        .select(F.col("first").alias("a"), F.col("id").alias("b"))
    )


def _apart(keep: Scratch, runs: DataFrame, found: DataFrame) -> DataFrame:
    """run, first, id, component of the runs whose members are in several components."""
    placed = keep(runs.join(found, "id", "left").select("run", "first", "id", F.coalesce("component", "id").alias("component")), "placed", narrow=True)
    several = placed.groupBy("run").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("run")
    out = keep(placed.join(several, "run"), "open-runs", narrow=True)
    keep.drop(placed)
    return out


def _rest(keep: Scratch, members: DataFrame, full: DataFrame, num: int, den: int) -> DataFrame:
    """a, b: links between sets of open runs; sets of a cluster's largest component are not compared with each other."""
    cluster = keep(components(members.where("id <> first"), "first", "id").withColumnRenamed("component", "cluster"), "clusters", narrow=True)
    sets = keep(members.select("id", "component").distinct().join(cluster, "id"), "cluster-sets", narrow=True)
    main = sets.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("cluster").agg(F.max_by("component", F.struct("n", "component")).alias("main"))
    sets = sets.join(main, "cluster").withColumn("apart", F.col("component") != F.col("main"))
    sizes = sets.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"), F.ceil(F.count_if("apart") / BLOCK).cast("int").alias("asking"))
    sets = keep(sets.select("id", "component", "cluster", "apart").join(sizes, "cluster"), "dealt-sets", narrow=True)
    block = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    there = sets.withColumn("i", block(F.col("blocks"))).withColumn("j", every(F.col("asking"))).withColumn("asks", F.lit(False))
    asks = sets.where("apart").withColumn("j", block(F.col("asking"))).withColumn("i", every(F.col("blocks"))).withColumn("asks", F.lit(True))
    dealt = there.unionByName(asks).select("cluster", "i", "j", "asks", "apart", "id", "component").join(full, "id")
    return dealt.groupBy("cluster", "i", "j").applyInPandas(_block_links(num, den), "a bigint, b bigint")


def jaccard_components(docs: DataFrame, width: int, num: int, den: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id of every row; links are where den * shared >= num * united."""
    spark, keep = docs.sparkSession, Scratch()
    tune(spark)
    docs = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    sets = keep(_sets(docs, width), "shingle-sets")
    groups = sets.where("n > 0 and id is not null").groupBy("n", "k1", "k2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    # written first, so that the join below can deal out the rows of a large group
    groups = keep(groups, "set-groups", narrow=True)
    total = sets.agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("features")).first()
    # over HOT of all rows each, so at most 1 / HOT groups
    hot = {(r["n"], r["k1"] % (1 << 64), r["k2"] % (1 << 64)): r["rep"] for r in groups.where(F.col("copies") > HOT * total["rows"] + 1).select("n", "k1", "k2", "rep").collect()}
    nodes = keep(sets.join(groups.drop("copies"), ["n", "k1", "k2"], "left").select("id", "n", "rep", F.when(F.col("id") == F.col("rep"), F.col("sketch")).alias("sketch")), "set-nodes")
    keep.drop(sets, groups)
    common = common_features(docs, width)
    # signatures of a feature, in both bands: differences, first-level parts for them, subsets
    share = 4.5 * SPARE * (den - num) / (den + num) * comb(PARTS, SUBSET) / (PARTS - SUBSET + 1)
    buckets = max(1, int((total["features"] or 0) * share / BUCKET_SIGS))
    found = keep(_runs(_packed(docs, width, num, den, hot, common, buckets)), "signature-runs")
    release(spark)

    rep = nodes.where("rep is not null").select(F.col("id"), "rep").distinct()
    runs = keep(found.join(rep, "id").select("run", F.col("rep").alias("id")).distinct(), "runs-of-sets", narrow=True)
    keep.drop(found)
    release(spark)
    sketches = nodes.where("sketch is not null").select("id", "n", "sketch").dropDuplicates(["id"])
    parts = F.pmod("run", F.lit(max(8, 4 * buckets))).alias("part")
    # written first, so that the join below can deal out the members of a large run
    sizes = keep(runs.groupBy("run").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("first")), "run-sizes", narrow=True)
    unsplit = runs.join(sizes, "run")
    parted = unsplit.where(F.col("size") <= LARGE).join(sketches, "id").groupBy(parts).applyInArrow(_split_runs(num, den), "run bigint, first bigint, id bigint").distinct()
    unsplit, runs = runs, keep(parted.unionByName(unsplit.where(F.col("size") > LARGE).select("run", "first", "id")), "set-runs")
    keep.drop(unsplit)
    release(spark)
    needed = runs.select("id").union(runs.select("first")).distinct()
    full = keep(_full_sets(docs, needed, width), "full-sets")
    links = keep(_verified(runs.where("id <> first").select("first", "id").distinct(), full, num, den), "star-links")
    found = keep(components(links, "a", "b"), "star-components", narrow=True)
    members = _apart(keep, runs, found)
    for k in range(PIVOTS):
        if members.isEmpty():
            break
        order = F.struct(F.xxhash64("id", F.lit(k)), "id", "component")
        pivots = members.groupBy("run").agg(F.min(order).alias("p")).select("run", F.col("p.id").alias("pivot"), F.col("p.component").alias("of"))
        pairs = members.join(pivots, "run").where("component <> of").select(F.col("pivot").alias("first"), "id").distinct()
        links = keep(links.union(_verified(pairs, full, num, den)), "pivot-links")
        found = keep(components(links, "a", "b"), "pivot-components", narrow=True)
        members = _apart(keep, members.select("run", "first", "id"), found)
    final = found if members.isEmpty() else components(links.union(_rest(keep, members, full, num, den)), "a", "b")
    keep.drop(*[df for df in keep.held if df is not nodes and df is not final])
    out = nodes.drop("sketch").join(final.withColumnRenamed("id", "rep"), "rep", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "id").alias("component_id"))


def drop_near_copies(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """One document of each component, the one with the smallest id, with all columns."""
    own = fresh(docs, "kept")
    kept = jaccard_components(docs, width, num, den).where("component_id = doc_id or doc_id is null").select(F.col("doc_id").alias(own)).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col(own)), "left_semi")


def op1_jaccard_join(spark, sf_dir):
    return jaccard_components(documents(spark, sf_dir), 3, 9, 10)


OP1_SQL = r"""
WITH RECURSIVE texts AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
    SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE concat(w[i], ' ', w[i + 1], ' ', w[i + 2]) END AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, least(len(w), 1) + 1))) AS i FROM texts) t),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
reached AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a)
SELECT t.doc_id, coalesce(max(s.n), 0)::BIGINT AS n_shingles, least(t.doc_id, coalesce(min(r.b), t.doc_id)) AS component_id
FROM texts t LEFT JOIN sizes s ON s.doc_id = t.doc_id LEFT JOIN reached r ON r.a = t.doc_id GROUP BY t.doc_id
"""
