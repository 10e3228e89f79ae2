"""Datasets of vector records: writes, reads, search, consolidation, imports.

A dataset is a chain of manifests.  A manifest names the base, the deltas over
it, and the change log, each with the block of sequence numbers (LSN) it holds.
Every read takes the newest row of each id over all three, so no read depends
on how far consolidation has come.  Files are written first and become part of
the dataset by one commit; a commit that is lost to another writer is applied
again to the newer state.
"""

from __future__ import annotations

import json
import time
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.control import MATCHES, MOST_MATCHES, MOST_PAGE, PAGE, check_name, decode_cursor, encode_cursor, iso_time
from .operators import search, state
from .plans import cells
from .sources import imports
from .sources.manifest import Files, Manifests

ROW = "id string, values array<float>, metadata string, deleted boolean, pos bigint"
COLUMNS = ["id", "values", "metadata", "lsn", "deleted"]
#: Deltas over one base before all is written as a new base; generations whose files are kept.
MAX_DELTAS, KEPT = 8, 2
#: Longest text of a rejected record that is kept.
TEXT = 2000
# Rows and seconds of rest after which a log is folded.
MOST_ROWS, IDLE = 2000, 60
#: Matches for which the number of probed cells is fitted when a base is written.
FITTED = 10


class Engine:
    """All datasets of one tenant under one folder of a store that every executor reaches; tenants share nothing."""

    def __init__(self, spark: SparkSession, root: str, tenant: str = "default", clock=time.time):
        self.spark, self.tenant, self.clock = spark, check_name(tenant), clock
        self.root = f"{root.rstrip('/')}/{tenant}"
        self.files = Files(spark, self.root)

    # ---- datasets

    def create(self, name: str, dimension: int) -> dict:
        if isinstance(dimension, bool) or not isinstance(dimension, int) or dimension < 1:
            raise ValueError("invalid_dimension")
        made = {"name": check_name(name), "dimension": dimension, "status": "empty", "life": uuid.uuid4().hex, "next_lsn": 1, "base": None, "deltas": [], "log": [], "created": self.clock(), "changed": self.clock()}

        def change(now):
            if now is not None and now["status"] != "deleted":
                raise ValueError("dataset_exists")
            return made

        return self._chain(name).commit(change)

    def datasets(self) -> list[dict]:
        """Those that are not deleted, by name."""
        found = [self._chain(name).latest() for name in self.files.names("") if not name.startswith(".")]
        return [d for d in found if d is not None and d["status"] != "deleted"]

    def describe(self, name: str) -> dict:
        found = self._chain(check_name(name)).latest()
        if found is None or found["status"] == "deleted":
            raise KeyError("dataset_not_found")
        return found

    def summary(self, name: str) -> dict:
        """What callers are shown of a dataset."""
        now = self.describe(name)
        return {
            "name": name, "dimension": now["dimension"], "status": now["status"], "row_count": self.count(name), "created_at": iso_time(now["created"]),
            "last_indexed_at": iso_time(now["indexed"]) if now.get("indexed") else None, "error_message": now.get("error"),
        }

    def fail_if_stale(self, name: str, seconds: float, message: str) -> bool:
        """Set a dataset that has been waiting for its index for too long to error, unless it has changed meanwhile."""
        done = []

        def change(now):
            done.clear()
            if now is None or now["status"] not in ("validating", "indexing") or self.clock() - now["changed"] < seconds:
                return None
            done.append(now)
            return now | {"status": "error", "error": message}

        self._chain(name).commit(change)
        return bool(done)

    def drop(self, name: str) -> None:
        """The dataset goes with its log; a new one of the same name starts empty."""
        self.describe(name)
        self._chain(name).commit(lambda now: now | {"status": "deleted", "base": None, "deltas": [], "log": []})

    def count(self, name: str) -> int:
        return self.state(name).count()

    # ---- writes

    def upsert(self, name: str, records: DataFrame, batch: tuple[str, int] | None = None) -> dict:
        """Records with id, values and optionally metadata (JSON); of rows with one id the last counts.

        A batch (stream, number) that the dataset has already taken is passed over.
        """
        dimension = self.describe(name)["dimension"]
        metadata = F.coalesce(F.col("metadata"), F.lit("{}")) if "metadata" in records.columns else F.lit("{}")
        rows = records.select(F.col("id").cast("string"), F.col("values").cast("array<float>"), metadata.alias("metadata"), F.lit(False).alias("deleted"))
        bad = F.coalesce((F.size("values") != dimension) | (F.length("id") == 0), F.lit(True)) | F.exists("values", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        return self._append(name, rows, bad, batch)

    def delete(self, name: str, ids: DataFrame) -> dict:
        """Tombstones for the ids; ids that are not there do no harm."""
        self.describe(name)
        empty = [F.lit(None).cast("array<float>").alias("values"), F.lit("{}").alias("metadata"), F.lit(True).alias("deleted")]
        return self._append(name, ids.select(F.col("id").cast("string"), *empty), F.col("id").isNull())

    def _append(self, name: str, rows: DataFrame, bad, batch: tuple[str, int] | None = None) -> dict:
        """Number the rows in their order, keep the last of each id, write them and commit a block of LSNs."""
        life = self.describe(name)["life"]
        scratch, path = f"{self.root}/{name}/scratch/{uuid.uuid4().hex}", f"{self.root}/{name}/data/log-{uuid.uuid4().hex}"
        try:
            rows.withColumn("p", F.monotonically_increasing_id()).write.parquet(scratch)
            held = self.spark.read.schema(rows.schema.add("p", "long")).parquet(scratch)
            if not held.where(bad).isEmpty():
                raise ValueError("invalid_record")
            # one count for each partition that wrote: the first position of each partition's rows
            part = F.shiftright("p", 33)
            sizes = sorted(held.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
            total = sum(r["n"] for r in sizes)
            if not total:
                return self.describe(name)
            firsts = np.cumsum([0, *[r["n"] for r in sizes]])
            offsets = self.spark.createDataFrame([(r["part"], int(first)) for r, first in zip(sizes, firsts)], "part bigint, first bigint")
            placed = held.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("pos", F.col("first") + F.col("p").bitwiseAND((1 << 33) - 1))
            state.last_wins(placed.drop("part", "p", "first"), "id", "pos").select("id", "values", "metadata", "deleted", "pos").write.parquet(path)
        finally:
            self.files.delete(scratch)

        def change(now):
            if now["life"] != life or now["status"] == "deleted":
                raise KeyError("dataset_not_found")
            streams = now.get("streams", {})
            if batch and streams.get(batch[0], -1) >= batch[1]:
                return None
            streams = streams | ({batch[0]: batch[1]} if batch else {})
            lo = now["next_lsn"]
            return now | {"streams": streams, "status": "indexing", "changed": self.clock(), "next_lsn": lo + total, "log": [*now["log"], {"path": path, "lo": lo, "hi": lo + total - 1}]}

        return self._chain(name).commit(change)

    # ---- reads

    def state(self, name: str, version: int | None = None) -> DataFrame:
        """id, values, metadata, lsn of the live records, now or at a version."""
        now = self.describe(name) if version is None else self._chain(name).read(version)
        return state.live(self._base(now).unionByName(self._recent(now))).drop("deleted")

    def lookup(self, name: str, identifier: str) -> tuple[str, dict | None]:
        """live and the record, or tombstone or absent; the base is read only for an id that nothing newer has."""
        now = self.describe(name)
        for rows in (self._recent(now), self._base(now)):
            found = rows.where(F.col("id") == identifier).orderBy(F.desc("lsn")).limit(1).collect()
            if found:
                return ("tombstone", None) if found[0]["deleted"] else ("live", self._record(found[0]))
        return "absent", None

    def get(self, name: str, identifier: str) -> dict | None:
        return self.lookup(name, identifier)[1]

    def page(self, name: str, limit: int = PAGE, cursor: str | None = None) -> dict:
        """Records in the order of their ids, and the cursor of the next page (None at the end): the last id of this one."""
        if limit < 1:
            raise ValueError("invalid_limit")
        limit, after = min(limit, MOST_PAGE), decode_cursor(cursor)
        rows = self.state(name).select("id", "metadata")
        rows = rows if after is None else rows.where(F.col("id") > after)
        found = rows.orderBy("id").limit(limit + 1).collect()
        return {"vectors": [{"id": r["id"], "metadata": json.loads(r["metadata"])} for r in found[:limit]], "next_cursor": encode_cursor(found[limit - 1]["id"]) if len(found) > limit else None}

    def query(self, name: str, vector: list[float], k: int = MATCHES, wanted: dict | None = None, probed: int | None = None) -> list[dict]:
        """The k nearest live records; with a filter all cells are read, so that min(k, matching) are found.

        Without a filter, as many cells are read as the base was found to need when it was written.
        """
        now = self.describe(name)
        if len(vector) != now["dimension"]:
            raise ValueError("dimension_mismatch")
        if not 1 <= k <= MOST_MATCHES:
            raise ValueError("invalid_top_k")
        base = self._base(now, keep_cell=True)
        if now["base"] and now["base"]["cells"] > 1 and not wanted:
            near = cells.nearest(np.asarray([vector], np.float32), self._centroids(now), probed or now["base"]["probed"])[0]
            base = base.where(F.col("cell").isin(*map(int, near)))
        newest = state.last_wins(self._recent(now))
        own = search.knn(newest.where(~F.col("deleted")), vector, k, wanted)
        # ids with newer rows leave the base before its nearest are cut
        cold = search.knn(base.join(newest.select("id"), "id", "left_anti"), vector, k, wanted)
        hits = search.merge_recent(own, cold, k).collect()
        if not hits:
            return []
        wanted_ids = F.col("id").isin(*[r["id"] for r in hits])
        rows = state.live(self._base(now).where(wanted_ids).unionByName(self._recent(now).where(wanted_ids))).select("id", "metadata").collect()
        metadata = {r["id"]: json.loads(r["metadata"]) for r in rows}
        return [{"id": r["id"], "score": r["score"], "metadata": metadata[r["id"]]} for r in hits]

    # ---- consolidation

    def consolidate(self, name: str) -> str:
        """Fold the log into the base or a delta: noop, full, delta, major, or skipped where another fold came first."""
        now = self.describe(name)
        if not now["log"]:
            return "noop"
        kind = "full" if not now["base"] else "delta" if len(now["deltas"]) < MAX_DELTAS else "major"
        path, lo = f"{self.root}/{name}/data/{kind}-{uuid.uuid4().hex}", now["log"][0]["lo"]
        entry = {"path": path, "lo": lo, "hi": now["log"][-1]["hi"]}
        if kind == "delta":
            placed = cells.assign(state.last_wins(self._logged(now)).select(*COLUMNS), self._centroids(now))
        else:
            live = self.state(name, now["version"]).withColumn("deleted", F.lit(False)).select(*COLUMNS)
            centroids = cells.train(live) if kind == "full" else self._centroids(now)
            placed = cells.assign(live, centroids)
            entry |= {"cells": max(1, len(centroids)), "centroids": now["base"]["centroids"] if kind == "major" else f"{path}-centroids"}
            if kind == "full":
                self._write_centroids(entry["centroids"], centroids)
            probing = centroids
        # rows of one cell meet in few files; a cell that is large is parted by id
        placed.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(8))).write.partitionBy("cell").parquet(path)
        if kind != "delta":
            entry["probed"] = search.calibrate(self._shard(path, keep_cell=True), probing, FITTED)
        folded = {e["path"] for e in now["log"]}

        def change(newer):
            if newer["life"] != now["life"] or newer["base"] != now["base"] or newer["deltas"] != now["deltas"] or not folded <= {e["path"] for e in newer["log"]}:
                return None
            log = [e for e in newer["log"] if e["path"] not in folded]
            levels = {"deltas": [*newer["deltas"], entry]} if kind == "delta" else {"base": entry, "deltas": []}
            return newer | levels | {"log": log, "status": "indexing" if log else "indexed", "error": None, "indexed": self.clock(), "changed": self.clock()}

        done = self._chain(name).commit(change)
        return kind if path in self._paths(done) else "skipped"

    def due(self, name: str) -> bool:
        """Whether the log is to be folded: it is long, or nothing was written for a while."""
        now = self.describe(name)
        rows = sum(e["hi"] - e["lo"] + 1 for e in now["log"])
        return rows > MOST_ROWS or rows > 0 and self.clock() - now["changed"] >= IDLE

    # ---- landed parts

    def land(self, name: str, records: DataFrame) -> str:
        """Write records (id, values, metadata) as a part that the next build takes in; parts are ordered by when they came."""
        self.describe(name)
        path = f"{self.root}/{name}/landing/{int(self.clock() * 1e6):020d}-{uuid.uuid4().hex}"
        metadata = F.coalesce(F.col("metadata"), F.lit("{}")) if "metadata" in records.columns else F.lit("{}")
        records.select(F.col("id").cast("string"), F.col("values").cast("array<float>"), metadata.alias("metadata")).write.parquet(path)
        return path

    def landed(self, name: str) -> list[str]:
        """Parts that have come and were not swept, the oldest first."""
        return [f"{self.root}/{name}/landing/{n}" for n in self.files.names(f"{name}/landing")]

    def build(self, name: str) -> str:
        """Take in the parts that no build has: noop, full, incremental (a delta), or error where a part has bad records.

        Of records with one id, the last of the latest part counts.
        """
        now = self.describe(name)
        new = [p for p in self.landed(name) if p not in now.get("built", [])]
        if not new:
            return "noop"
        rows = self.spark.read.schema("id string, values array<float>, metadata string").parquet(*new)
        rows = rows.select("id", "values", "metadata", F.struct("_metadata.file_path", "_metadata.row_index").alias("at"))
        try:
            self.upsert(name, state.last_wins(rows, "id", "at").select("id", "values", "metadata"), ("landing", int(new[-1].rsplit("/", 1)[1].split("-")[0])))
        except ValueError:
            self._chain(name).commit(lambda newer: newer | {"status": "error", "error": "a landed part has bad records"})
            return "error"
        self._chain(name).commit(lambda newer: newer | {"built": [p for p in newer.get("built", []) if p not in new] + new})
        return {"delta": "incremental", "major": "incremental"}.get(done := self.consolidate(name), done)

    def sweep_landed(self, name: str) -> int:
        """Delete the parts that a build has taken in."""
        built = self.describe(name).get("built", [])
        gone = [p for p in self.landed(name) if p in built]
        for path in gone:
            self.files.delete(path)
        if built:
            self._chain(name).commit(lambda newer: newer | {"built": [p for p in newer.get("built", []) if p not in built]})
        return len(gone)

    def sweep(self, name: str, keep: int = KEPT) -> int:
        """Delete files that only manifests older than the newest keep bases name; returns how many folders."""
        chain = self._chain(name)
        versions, bases, kept, gone, old = sorted(chain.versions(), reverse=True), set(), set(), set(), []
        for number in versions:
            own = chain.read(number)
            bases.add(own["base"]["path"] if own["base"] else None)
            if len(bases) <= max(1, keep):
                kept |= self._paths(own)
            else:
                gone |= self._paths(own)
                old.append(number)
        # the folders first, the manifests that name them last: a sweep that stops halfway can be run again
        for path in gone - kept:
            self.files.delete(path)
        for number in old:
            self.files.delete(f"{self.root}/{chain.folder}/{number:012d}.json")
        return len(gone - kept)

    # ---- imports

    def import_file(self, name: str, path: str, kind: str | None = None, abort: bool = False, max_bad: int | None = None) -> dict:
        """Records of a file or folder whose kind, where it isn't given, the name's ending tells."""
        kind = kind or imports.kind_of(path)
        if kind == "parquet":
            return self.import_parquet(name, path, abort, max_bad)
        return self._import(name, imports.lines_of(self.spark, path, kind), abort, max_bad)

    def import_lines(self, name: str, path: str, abort: bool = False, max_bad: int | None = None) -> dict:
        """Newline-delimited records; rejected lines are written beside the dataset, good ones appended unless the job fails."""
        return self._import(name, imports.numbered_lines(self.spark, path), abort, max_bad)

    def import_parquet(self, name: str, path: str, abort: bool = False, max_bad: int | None = None) -> dict:
        """Records with id, values and optionally metadata (a struct or map); other columns fail the job."""
        rows = self.spark.read.parquet(path)
        kinds = dict(rows.dtypes)
        if set(kinds) - {"metadata"} != {"id", "values"} or kinds["id"] != "string" or kinds["values"] not in ("array<float>", "array<double>") or not kinds.get("metadata", "map<").startswith(("struct<", "map<", "string")):
            raise ValueError("invalid_schema")
        if kinds.get("metadata") == "string":
            rows = rows.withColumn("metadata", F.try_parse_json("metadata"))
        line = [F.input_file_name().alias("file"), (F.monotonically_increasing_id() + 1).alias("line")]
        return self._import(name, rows.select(*line, F.to_json(F.struct(*rows.columns)).alias("text")), abort, max_bad)

    def _import(self, name: str, lines: DataFrame, abort: bool, max_bad: int | None) -> dict:
        job = uuid.uuid4().hex
        found, scratch = imports.checked(lines, self.describe(name)["dimension"]), f"{self.root}/{name}/scratch/{job}"
        try:
            found.write.parquet(scratch)
            held = self.spark.read.schema(found.schema).parquet(scratch)
            result = imports.outcome(held, abort, max_bad).first().asDict() | {"job": job}
            imports.rejected(held, TEXT).write.json(f"{self.root}/{name}/rejected/{job}")
            if not result["failed"] and result["accepted"]:
                self.upsert(name, held.where("reason is null").select("id", "values", "metadata"))
        finally:
            self.files.delete(scratch)
        return result

    # ---- parts

    def _chain(self, name: str) -> Manifests:
        return Manifests(self.files, name)

    @staticmethod
    def _paths(now: dict) -> set[str]:
        base = [now["base"]["path"], now["base"]["centroids"]] if now["base"] else []
        return {*base, *[e["path"] for e in now["deltas"] + now["log"]]}

    @staticmethod
    def _record(row) -> dict:
        return {"id": row["id"], "values": list(row["values"]), "metadata": json.loads(row["metadata"])}

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], "id string, values array<float>, metadata string, lsn bigint, deleted boolean")

    def _shard(self, path: str, keep_cell: bool = False) -> DataFrame:
        rows = self.spark.read.schema("id string, values array<float>, metadata string, lsn bigint, deleted boolean, cell int").parquet(path)
        return rows.select(*COLUMNS, *(["cell"] if keep_cell else []))

    def _base(self, now: dict, keep_cell: bool = False) -> DataFrame:
        if now["base"]:
            return self._shard(now["base"]["path"], keep_cell)
        return self._empty().withColumn("cell", F.lit(0)) if keep_cell else self._empty()

    def _logged(self, now: dict) -> DataFrame:
        """Rows of the log with their sequence numbers."""
        out = self._empty()
        for e in now["log"]:
            out = out.unionByName(self.spark.read.schema(ROW).parquet(e["path"]).select("id", "values", "metadata", (F.col("pos") + e["lo"]).alias("lsn"), "deleted"))
        return out

    def _recent(self, now: dict) -> DataFrame:
        """All that is newer than the base, tombstones included."""
        out = self._logged(now)
        for e in now["deltas"]:
            out = out.unionByName(self._shard(e["path"]))
        return out

    def _write_centroids(self, path: str, centroids: np.ndarray) -> None:
        rows = [(i, [float(x) for x in c]) for i, c in enumerate(centroids)]
        self.spark.createDataFrame(rows, "cell int, centroid array<float>").coalesce(1).write.parquet(path)

    def _centroids(self, now: dict) -> np.ndarray:
        """The base's centroids, MOST_CELLS at most."""
        rows = sorted(self.spark.read.schema("cell int, centroid array<float>").parquet(now["base"]["centroids"]).collect())
        return np.asarray([r["centroid"] for r in rows], np.float32) if rows else np.zeros((0, 0), np.float32)
