"""Registry of the core queries and of their oracle SQL.

Queries are built from the operators; each oracle is a statement of its own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .engine import Engine
from .functions import expressions as X
from .operators import generations, search, state
from .plans import cells
from .sources import imports

QUERIES: dict = {}
ORACLE_SQL: dict = {}

DISTANCE = "list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))"
RECORDS = "records AS (SELECT concat('v', CAST(vec_id AS STRING)) AS id, vec_id + 1 AS lsn, label, vec_id FROM embeddings)"
LOG = """log AS (SELECT id, lsn, label, vec_id % 17 = 0 AS deleted FROM records WHERE vec_id % 5 = 0
UNION ALL SELECT id, lsn + 100000 AS lsn, label + 10 AS label, false AS deleted FROM records WHERE vec_id % 7 = 0)"""
COLD = "cold AS (SELECT id, lsn, label FROM records WHERE vec_id % 5 <> 0)"
NEWEST = "newest AS (SELECT id, lsn, label, deleted FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY lsn DESC) AS r FROM log) t WHERE r = 1)"
SHARDS = """shards AS (SELECT * FROM (VALUES
 (1, 'a', 0, 0, 'q1', 0, 100, 100, 10), (2, 'a', 1, 1, 'q1', 101, 110, 0, 11), (3, 'a', 1, 1, 'q1', 111, 120, 0, 12),
 (4, 'a', 1, 1, 'q0', 121, 130, 0, 13), (5, 'a', 0, 0, 'q2', 0, 200, 200, 20), (6, 'a', 1, 5, 'q2', 201, 230, 0, 21),
 (7, 'a', 1, 5, 'q2', 260, 269, 0, 22), (8, 'b', 0, 0, 'q3', 0, 0, 55, 30), (9, 'b', 1, 8, 'q3', 56, 60, 0, 31),
 (10, 'a', 0, 0, 'q4', 0, 300, 300, 40)) AS t(shard, dataset, level, parent, quantizer, lo, hi, consolidated, created))"""
GENERATIONS = """bases AS (SELECT shard AS base, dataset, quantizer, CASE WHEN hi = 0 THEN consolidated ELSE hi END AS frontier, created,
 row_number() OVER (PARTITION BY dataset ORDER BY created DESC, shard DESC) AS generation FROM shards WHERE level = 0),
members AS (SELECT b.dataset, b.base, b.generation, b.base AS shard, -1 AS lo, b.frontier AS hi FROM bases b
 UNION ALL SELECT b.dataset, b.base, b.generation, s.shard, s.lo, s.hi FROM bases b JOIN shards s ON s.level = 1 AND s.parent = b.base AND s.quantizer = b.quantizer),
walked AS (SELECT *, CASE WHEN lo = -1 OR lo = lag(hi) OVER (PARTITION BY base ORDER BY lo, shard) + 1 THEN 1 ELSE 0 END AS ok FROM members),
joined AS (SELECT *, min(ok) OVER (PARTITION BY base ORDER BY lo, shard ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS all_ok FROM walked),
frontiers AS (SELECT dataset, base, generation, max(hi) AS frontier FROM joined WHERE all_ok = 1 GROUP BY dataset, base, generation)"""
JOBS = """lines AS (SELECT event_id AS line, CASE event_id % 7 WHEN 0 THEN 'invalid_json' WHEN 1 THEN 'dimension_mismatch' WHEN 2 THEN 'invalid_id' END AS reason,
 concat(event_type, ' ', CAST(event_id AS STRING)) AS text, user_id AS job FROM events)"""


def _views(spark, sf_dir: str, tables) -> None:
    for table in tables:
        spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)


def operated(name: str, body: str, *parts: str, run) -> None:
    """A query of operators with a statement of its own as oracle."""
    QUERIES[name], ORACLE_SQL[name] = run, ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


#: The queries over the literal shards, by operators that take any.
OVER_SHARDS = {
    "latest_shard": generations.latest,
    "generations": lambda shards: generations.members(shards).select("dataset", "base", "generation", "shard"),
    "frontier_watermark": lambda shards: generations.frontiers(shards).select("dataset", "base", "frontier"),
    "dataset_watermark": generations.dataset_watermark,
    "grace_watermark": generations.grace_watermark,
    "superseded_shards": generations.superseded,
    "watermark_carry": generations.watermark_carry,
}


def over_shards(name: str, body: str, *parts: str) -> None:
    operated(name, body, *parts, run=lambda spark, sf_dir: OVER_SHARDS[name](spark.sql(f"WITH {SHARDS} SELECT * FROM shards")))


IMPORTED = """SELECT event_id AS line, user_id AS job, concat(event_type, ' ', CAST(event_id AS STRING)) AS note, CASE event_id % 7 WHEN 0 THEN '{not json'
 WHEN 1 THEN '{"id": "a", "values": [1, 2, 3]}' WHEN 2 THEN '{"id": "", "values": [1, 2]}' ELSE concat('{"id": "', event_type, '", "values": [', CAST(event_id AS STRING), ', 2.5]}') END AS text FROM events"""
#: The queries over checked lines; the oracle's text of a line is its note, cut at 12 characters.
OVER_LINES = {
    "import_counters": lambda rows: imports.outcome(rows, False, by=("job",)).select("job", "processed", "accepted", "rejected"),
    "import_policy": lambda rows: imports.outcome(rows, False, 25, by=("job",)).select("job", "first_bad", "failed"),
    "import_rejected": lambda rows: imports.rejected(rows.withColumn("text", F.col("note")), 12),
}


def over_lines(name: str, body: str, *parts: str) -> None:
    def run(spark, sf_dir):
        _views(spark, sf_dir, ("events",))
        return OVER_LINES[name](imports.checked(spark.sql(IMPORTED), 2, False, keep=("job", "note")))

    operated(name, body, *parts, run=run)


class Given:
    """The tables of a query: records, a log of changes to them, and the cold rows that the log came after."""

    def __init__(self, spark, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @property
    def events(self):
        return self.spark.read.parquet(f"{self.sf_dir}/events.parquet")

    @property
    def records(self):
        rows = self.spark.read.parquet(f"{self.sf_dir}/embeddings.parquet")
        return rows.select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("id"), (F.col("vec_id") + 1).alias("lsn"), "label", "vec_id")

    @property
    def log(self):
        first = self.records.where("vec_id % 5 = 0").select("id", "lsn", "label", (F.col("vec_id") % 17 == 0).alias("deleted"))
        return first.unionByName(self.records.where("vec_id % 7 = 0").select("id", (F.col("lsn") + 100000).alias("lsn"), (F.col("label") + 10).alias("label"), F.lit(False).alias("deleted")))

    @property
    def cold(self):
        return self.records.where("vec_id % 5 <> 0").select("id", "lsn", "label")

    def bands(self):
        rows = self.records
        part = lambda where, more: rows.where(where).select("id", (F.col("label") + more).alias("label"))
        return state.stacked(part("vec_id % 5 <> 0", 0), part("vec_id % 3 = 0", 100), part("vec_id % 4 = 0", 200)).select("id", "label", "band")

    def tombstones(self):
        return self.records.where("vec_id % 17 = 0").select("id", F.lit(2).alias("band"))

    def last_event(self) -> int:
        return self.events.agg(F.coalesce(F.max("event_id"), F.lit(0))).first()[0]

    def parts(self, where: str):
        return self.events.where(where).select(F.concat(F.lit("part-"), F.col("event_id").cast("string")).alias("part"))


#: The queries over a dataset's rows, by operators that take any.
OVER_ROWS = {
    "lsn_assign": lambda g: state.numbered(g.events.select("user_id", "event_id"), "user_id", "event_id", 501),
    "recall_scan": lambda g: state.since(g.log, 50),
    "recall_snapshot": lambda g: state.upto(g.log, state.high_water(g.log)).select("id", "lsn", "deleted"),
    "union_suppress_anti": lambda g: state.without(g.cold, state.last_wins(g.log)),
    "list_union": lambda g: state.united(g.cold.select("id", "label"), g.log),
    "list_page": lambda g: state.page(g.records.select("id"), 100, skip=100),
    "get_union": lambda g: state.points(g.cold.select("id", "label"), g.log, ["v5", "v7", "v34"]).drop("tier"),
    "get_vector": lambda g: g.records.where("id = 'v42'").select("id", "label", "lsn"),
    "recall_trim": lambda g: state.trim(g.log, 200),
    "partition_count": lambda g: state.held(g.log),
    "idle_partitions": lambda g: state.idle(g.events, "user_id", "event_id", F.lit(g.last_event() - 100)),
    "tombstone_suppress": lambda g: state.gone(g.log, g.tombstones()),
    "delta_union": lambda g: g.bands(),
    "delta_newest_wins": lambda g: state.last_wins(g.bands(), "id", "band"),
    "major_compaction": lambda g: state.compacted(g.bands(), g.tombstones()).select("id", "label"),
    "new_parts": lambda g: state.new_parts(g.parts("event_id % 10 < 4"), g.parts("event_id % 10 < 3")),
    "overlap_semi": lambda g: state.with_newer(g.cold, state.last_wins(g.log)).select("id"),
    "union_rebuild": lambda g: state.united(g.cold.select("id", "label"), g.log),
    "delete_by_id": lambda g: state.deleted(g.cold.select("id", "label"), ["v6"]),
    "fold_new_rows": lambda g: state.since(g.log, 100000),
    "delta_fold": lambda g: state.folded(g.log, 100000),
    "row_count": lambda g: state.united(g.cold.select("id", "label"), g.log).agg(F.count(F.lit(1)).alias("n")),
    "hit_mapping": lambda g: state.named_hits(g.events.select("event_id", (F.col("event_id") % 700).alias("hit")), g.records.select(F.col("vec_id").alias("hit"), "id")),
    "stale_datasets": lambda g: state.idle(g.events.where("event_type IN ('view', 'click')"), "user_id", "event_id", F.lit(g.last_event() - 200)).withColumnRenamed("newest", "last_event"),
    "latency_stats": lambda g: g.events.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean_value"), F.max("value").alias("max_value"), F.count(F.lit(1)).alias("n")),
}


def over_rows(name: str, body: str, *parts: str) -> None:
    operated(name, body, *parts, run=lambda spark, sf_dir: OVER_ROWS[name](Given(spark, sf_dir)))


def built(name: str, oracle: str | None):
    def add(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLE_SQL[name] = oracle
        return function

    return add


def records(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("id"), F.col("embedding").alias("values"), F.to_json(F.struct("label")).alias("metadata"), "label", "vec_id"
    )


def query_vectors(spark, sf_dir):
    """The stated query set: every vector whose id is divisible by 100."""
    return records(spark, sf_dir).where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("values").alias("query"))


def one_vector(spark, sf_dir):
    row = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id = 0").select("embedding").first()
    return list(row[0])


def rounded(df):
    return df.withColumn("score", F.round("score", 6))


ONE = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"


@built("l2_squared", f"SELECT vec_id, round({DISTANCE.format(a='embedding', b=ONE)}, 6) AS score FROM embeddings")
def _l2(spark, sf_dir):
    vector = F.array(*[F.lit(x).cast("float") for x in one_vector(spark, sf_dir)])
    return records(spark, sf_dir).select("vec_id", F.round(X.l2_squared(F.col("values"), vector), 6).alias("score"))


NEAREST = "SELECT id, round(d, 6) AS score FROM (SELECT concat('v', vec_id::STRING) AS id, " + DISTANCE.format(a="embedding", b=ONE) + " AS d FROM embeddings WHERE {}) t ORDER BY d, id LIMIT 10"


@built("knn_exact", NEAREST.format("true"))
def _knn(spark, sf_dir):
    return rounded(search.knn(records(spark, sf_dir), one_vector(spark, sf_dir), 10))


@built("filter_knn", NEAREST.format("label = 3"))
def _filter_knn(spark, sf_dir):
    return rounded(search.knn(records(spark, sf_dir), one_vector(spark, sf_dir), 10, {"label": 3}))


RANKED = f"""s AS (SELECT q.vec_id AS qid, concat('v', r.vec_id::STRING) AS id, r.label, {DISTANCE.format(a='r.embedding', b='q.embedding')} AS d FROM embeddings r, embeddings q WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS rank FROM s)"""
BATCH = f"WITH {RANKED} SELECT qid, id, round(d, 6) AS score, rank FROM ranked WHERE rank <= 10"


@built("knn_batch", BATCH)
def _knn_batch(spark, sf_dir):
    return rounded(search.knn_batch(records(spark, sf_dir).select("id", "values"), query_vectors(spark, sf_dir), 10))


def _cells(spark, sf_dir):
    """Records in the cells of centroids that k-means trained on a bounded sample."""
    rows = records(spark, sf_dir).select("id", "values")
    centroids = cells.train(rows)
    return cells.assign(rows, centroids), centroids


@built("ivf_full_probe", BATCH)
def _full_probe(spark, sf_dir):
    placed, centroids = _cells(spark, sf_dir)
    return rounded(search.probe(placed, centroids, query_vectors(spark, sf_dir), cells.MOST_CELLS, 10))


@built("ivf_probe", None)
def _probe(spark, sf_dir):
    placed, centroids = _cells(spark, sf_dir)
    return rounded(search.probe(placed, centroids, query_vectors(spark, sf_dir), search.calibrate(placed, centroids, 10), 10))


@built("ivf_recall", None)
def _ivf_recall(spark, sf_dir):
    """Share of the exact nearest ten that the pruned search finds."""
    return search.agreement(_knn_batch(spark, sf_dir), _probe(spark, sf_dir))


@built("recall_at_k", f"""WITH {RANKED}, top AS (SELECT qid, id, label FROM ranked WHERE rank <= 10),
partial AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS rank FROM s WHERE label % 3 <> 0)
SELECT t.qid, count(o.id) / count(*) AS recall FROM top t LEFT JOIN (SELECT qid, id FROM partial WHERE rank <= 10) o ON t.qid = o.qid AND t.id = o.id GROUP BY t.qid""")
def _recall(spark, sf_dir):
    """What a search that lacks a part of the records finds of the exact nearest ten."""
    rows = records(spark, sf_dir)
    return search.agreement(_knn_batch(spark, sf_dir), search.knn_batch(rows.where("label % 3 <> 0").select("id", "values"), query_vectors(spark, sf_dir), 10))


@built("similarity", f"SELECT vec_id, round(1 / (1 + {DISTANCE.format(a='embedding', b=ONE)}), 6) AS similarity FROM embeddings")
def _similarity(spark, sf_dir):
    vector = F.array(*[F.lit(x).cast("float") for x in one_vector(spark, sf_dir)])
    return records(spark, sf_dir).select("vec_id", F.round(X.similarity(X.l2_squared(F.col("values"), vector)), 6).alias("similarity"))


@built("id_hash", "SELECT concat('v', vec_id::STRING) AS id, CAST(('0x' || substr(sha1(concat('v', vec_id::STRING)), 1, 16))::UBIGINT & 9223372036854775807 AS BIGINT) AS id64 FROM embeddings")
def _id_hash(spark, sf_dir):
    return records(spark, sf_dir).select("id", X.id_to_int64(F.col("id")).alias("id64"))


@built("vector_literal", "SELECT vec_id, true AS same, CAST(len(embedding) AS INT) AS n FROM embeddings")
def _literal(spark, sf_dir):
    back = X.parse_vector(X.vector_literal(F.col("values")))
    return records(spark, sf_dir).select("vec_id", (back == F.col("values")).alias("same"), F.size(back).alias("n"))


MIXED = """WITH m AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN '{"k": 1}' WHEN 1 THEN '{"k": 1.0}' WHEN 2 THEN '{"k": true}' WHEN 3 THEN '{"k": "1"}' WHEN 4 THEN '{"k": null}' ELSE '{"j": 1}' END AS metadata FROM events)"""


def _filtered(name: str, wanted: dict, remainder: int | None) -> None:
    oracle = f"SELECT event_id FROM events WHERE {'false' if remainder is None else f'event_id % 6 = {remainder}'}"

    @built(name, oracle)
    def run(spark, sf_dir):
        _views(spark, sf_dir, ("events",))
        rows = spark.sql(MIXED + " SELECT * FROM m")
        return rows.where(X.metadata_matches(F.col("metadata"), wanted)).select("event_id")


_filtered("filter_and_equals", {"k": 1}, 0)
_filtered("filter_type_float", {"k": 1.0}, 1)
_filtered("filter_type_bool", {"k": True}, 2)
_filtered("filter_type_mismatch", {"k": "1"}, 3)
_filtered("filter_null", {"k": None}, None)
_filtered("filter_missing_key", {"none": 1}, None)


@built("filter_two_keys", "SELECT event_id FROM events WHERE event_id % 4 = 1")
def _two_keys(spark, sf_dir):
    """Both keys must match; rows lack one, hold null in one, or are no object at all."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    kinds = F.array(*[F.lit(x) for x in ('{"k": 1}', '{"k": 1, "j": "a b", "more": [1]}', '{"k": 1, "j": null}', "[1]")])
    return rows.select("event_id", kinds[F.pmod("event_id", F.lit(4)).cast("int")].alias("metadata")).where(X.metadata_matches(F.col("metadata"), {"k": 1, "j": "a b"})).select("event_id")


@built("dedup_last_wins", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def _last(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "event_type")
    return state.last_wins(rows, "user_id", "event_id").select("user_id", "event_id", "event_type")


over_rows("lsn_assign", "SELECT user_id, event_id, 500 + CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS lsn FROM events")
over_rows("recall_scan", "SELECT id, lsn, label, deleted FROM newest WHERE lsn > 50", RECORDS, LOG, NEWEST)
over_rows("recall_snapshot", "SELECT id, lsn, deleted FROM newest WHERE lsn <= (SELECT coalesce(max(lsn), 0) FROM log)", RECORDS, LOG, NEWEST)
over_rows("union_suppress_anti", "SELECT c.id, c.lsn, c.label FROM cold c LEFT ANTI JOIN newest n ON c.id = n.id".replace("LEFT ANTI", "ANTI"), RECORDS, LOG, NEWEST, COLD)
over_rows("list_union", "SELECT id, label FROM newest WHERE NOT deleted UNION ALL SELECT c.id, c.label FROM cold c WHERE NOT EXISTS (SELECT 1 FROM newest n WHERE n.id = c.id)", RECORDS, LOG, NEWEST, COLD)
over_rows("list_page", "SELECT id FROM records ORDER BY id LIMIT 100 OFFSET 100", RECORDS)
over_rows("get_union", "SELECT id, label FROM (SELECT id, label, 0 AS tier FROM newest WHERE id IN ('v5', 'v7', 'v34') AND NOT deleted UNION ALL SELECT c.id, c.label, 1 AS tier FROM cold c WHERE c.id IN ('v5', 'v7', 'v34') AND NOT EXISTS (SELECT 1 FROM newest n WHERE n.id = c.id)) t", RECORDS, LOG, NEWEST, COLD)
over_rows("get_vector", "SELECT id, label, lsn FROM records WHERE id = 'v42'", RECORDS)
over_rows("recall_trim", "SELECT id, lsn, label, deleted FROM log WHERE lsn > 200", RECORDS, LOG)
over_rows("partition_count", "SELECT CAST(count(*) AS BIGINT) AS n, max(lsn) AS watermark FROM newest", RECORDS, LOG, NEWEST)
over_rows("idle_partitions", "SELECT user_id, CAST(max(event_id) AS BIGINT) AS newest FROM events GROUP BY user_id HAVING max(event_id) <= (SELECT max(event_id) - 100 FROM events)")
over_shards("latest_shard", "SELECT dataset, shard FROM (SELECT dataset, shard, row_number() OVER (PARTITION BY dataset ORDER BY created DESC, shard DESC) AS r FROM shards) t WHERE r = 1", SHARDS)
over_shards("generations", "SELECT dataset, base, CAST(generation AS BIGINT) AS generation, shard FROM members", SHARDS, GENERATIONS)
over_shards("frontier_watermark", "SELECT dataset, base, frontier FROM frontiers", SHARDS, GENERATIONS)
over_shards("dataset_watermark", "SELECT dataset, max(frontier) AS watermark FROM frontiers WHERE generation = 1 GROUP BY dataset", SHARDS, GENERATIONS)
over_shards("grace_watermark", "SELECT dataset, coalesce(max(CASE WHEN generation = 2 THEN frontier END), 0) AS grace FROM frontiers GROUP BY dataset", SHARDS, GENERATIONS)
over_shards("superseded_shards", "SELECT shard FROM shards WHERE shard NOT IN (SELECT shard FROM members WHERE generation <= 2)", SHARDS, GENERATIONS)
over_shards("watermark_carry", "SELECT shard, dataset, max(consolidated) OVER (PARTITION BY dataset ORDER BY created ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS consolidated FROM shards", SHARDS)
over_rows("tombstone_suppress", "SELECT id FROM newest UNION SELECT id FROM records WHERE vec_id % 17 = 0", RECORDS, LOG, NEWEST)
BANDS = "bands AS (SELECT id, label, 1 AS band FROM records WHERE vec_id % 5 <> 0 UNION ALL SELECT id, label + 100 AS label, 2 AS band FROM records WHERE vec_id % 3 = 0 UNION ALL SELECT id, label + 200 AS label, 3 AS band FROM records WHERE vec_id % 4 = 0)"
over_rows("delta_union", "SELECT id, label, band FROM bands", RECORDS, BANDS)
over_rows("delta_newest_wins", "SELECT id, label, band FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY band DESC) AS r FROM bands) t WHERE r = 1", RECORDS, BANDS)
over_rows("major_compaction", "SELECT id, label FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY band DESC, dead DESC) AS r FROM (SELECT id, label, band, 0 AS dead FROM bands UNION ALL SELECT id, label, 2 AS band, 1 AS dead FROM records WHERE vec_id % 17 = 0) u) t WHERE r = 1 AND dead = 0", RECORDS, BANDS)
over_rows("new_parts", "SELECT concat('part-', CAST(event_id AS STRING)) AS part FROM events WHERE event_id % 10 < 4 EXCEPT SELECT concat('part-', CAST(event_id AS STRING)) AS part FROM events WHERE event_id % 10 < 3")
over_rows("overlap_semi", "SELECT c.id FROM cold c WHERE EXISTS (SELECT 1 FROM newest n WHERE n.id = c.id)", RECORDS, LOG, NEWEST, COLD)
over_rows("union_rebuild", "SELECT c.id, c.label FROM cold c WHERE NOT EXISTS (SELECT 1 FROM newest n WHERE n.id = c.id) UNION ALL SELECT id, label FROM newest WHERE NOT deleted", RECORDS, LOG, NEWEST, COLD)
over_rows("delete_by_id", "SELECT id, label FROM cold WHERE id <> 'v6'", RECORDS, COLD)
over_rows("fold_new_rows", "SELECT id, lsn, label, deleted FROM newest WHERE lsn > 100000", RECORDS, LOG, NEWEST)
over_rows("delta_fold", "SELECT CAST(100001 AS BIGINT) AS lo, max(lsn) AS hi, CAST(count(*) AS BIGINT) AS row_count, CAST(sum(CASE WHEN deleted THEN 1 ELSE 0 END) AS BIGINT) AS tombstones FROM newest WHERE lsn > 100000", RECORDS, LOG, NEWEST)
over_rows("row_count", "SELECT CAST(count(DISTINCT id) AS BIGINT) AS n FROM (SELECT id FROM cold UNION ALL SELECT id FROM newest WHERE NOT deleted) t", RECORDS, LOG, NEWEST, COLD)
over_lines("import_counters", "SELECT job, CAST(count(*) AS BIGINT) AS processed, CAST(sum(CASE WHEN reason IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS accepted, CAST(sum(CASE WHEN reason IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS rejected FROM lines GROUP BY job", JOBS)
over_lines("import_policy", "SELECT job, min(CASE WHEN reason IS NOT NULL THEN line END) AS first_bad, sum(CASE WHEN reason IS NOT NULL THEN 1 ELSE 0 END) > 25 AS failed FROM lines GROUP BY job", JOBS)
over_lines("import_rejected", "SELECT line, reason, CASE WHEN length(text) > 12 THEN concat(substr(text, 1, 12), '...[truncated]') ELSE text END AS text FROM lines WHERE reason IS NOT NULL", JOBS)
over_rows("hit_mapping", "SELECT h.event_id, h.hit, coalesce(r.id, CAST(h.hit AS STRING)) AS id FROM (SELECT event_id, event_id % 700 AS hit FROM events) h LEFT JOIN records r ON r.vec_id = h.hit", RECORDS)
over_rows("stale_datasets", "SELECT user_id, max(event_id) AS last_event FROM events WHERE event_type IN ('view', 'click') GROUP BY user_id HAVING max(event_id) <= (SELECT max(event_id) - 200 FROM events)")
over_rows("latency_stats", "SELECT event_type, round(avg(value), 6) AS mean_value, max(value) AS max_value, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY event_type")


@built("latency_percentiles", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type")
def _percentiles(spark, sf_dir):
    return state.spread(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_type", "value", p50=0.5, p95=0.95, p99=0.99)


@built("union_query", f"""WITH s AS (SELECT concat('v', vec_id::STRING) AS id, vec_id % 5 = 0 AS recent, {DISTANCE.format(a='embedding', b=ONE)} AS d FROM embeddings WHERE vec_id % 5 <> 0 OR vec_id % 17 <> 0)
SELECT id, round(d, 6) AS score FROM s ORDER BY d, recent DESC, id LIMIT 10""")
def _union_query(spark, sf_dir):
    rows, vector = records(spark, sf_dir), F.array(*[F.lit(x).cast("float") for x in one_vector(spark, sf_dir)])
    scored = rows.select("id", "vec_id", X.l2_squared(F.col("values"), vector).alias("score"))
    recent = scored.where("vec_id % 5 = 0")
    cold = scored.where("vec_id % 5 <> 0").select("id", "score")
    merged = search.merge_recent(recent.where("vec_id % 17 <> 0").select("id", "score"), cold, 10, recent)
    return rounded(merged.select("id", "score"))


@built("consolidate", "WITH " + ",\n".join((RECORDS, LOG, COLD)) + """, upto AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY lsn DESC) AS r FROM log WHERE lsn <= 100100) t WHERE r = 1)
SELECT id, lsn, label FROM cold WHERE id NOT IN (SELECT id FROM upto) UNION ALL SELECT id, lsn, label FROM upto WHERE NOT deleted""")
def _consolidate(spark, sf_dir):
    _views(spark, sf_dir, ("embeddings",))
    base = spark.sql(f"WITH {RECORDS}, {COLD} SELECT * FROM cold")
    return state.consolidate(base, spark.sql(f"WITH {RECORDS}, {LOG} SELECT * FROM log"), 100100)


@built("incremental_build", "WITH " + ",\n".join((RECORDS, COLD)) + " SELECT id, lsn, label FROM cold UNION ALL SELECT id, lsn, label FROM records WHERE vec_id % 10 = 5")
def _incremental(spark, sf_dir):
    _views(spark, sf_dir, ("embeddings",))
    rows = spark.sql(f"WITH {RECORDS} SELECT * FROM records")
    base, parts = rows.where("vec_id % 5 <> 0"), rows.where("vec_id % 10 = 5")
    return state.appended(base, parts).select("id", "lsn", "label")


@built("choose_nlist", "SELECT n, CAST(greatest(1, least(CAST(floor(4 * sqrt(n)) AS BIGINT), 4096, greatest(1, n // 8))) AS BIGINT) AS nlist FROM (SELECT event_id * event_id + 1 AS n FROM events) t")
def _nlist(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("event_id") * F.col("event_id") + 1).alias("n"))
    return rows.select("n", search.cells_for(F.col("n")).cast("bigint").alias("nlist"))


HOSTS = ("http://a:1", "http://b:2", "http://c:3")


@built("hrw_rank", "SELECT user_id, url, CAST(row_number() OVER (PARTITION BY user_id ORDER BY sha256(concat(user_id::STRING, '|', url)) DESC) AS BIGINT) AS rank FROM (SELECT DISTINCT user_id FROM events) u, (VALUES ('http://a:1'), ('http://b:2'), ('http://c:3')) AS h(url)")
def _hrw_rank(spark, sf_dir):
    keys = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct()
    digest = lambda url: F.sha2(F.concat(F.col("user_id").cast("string"), F.lit("|"), F.lit(url)), 256)
    ranked = F.reverse(F.array_sort(F.array(*[F.struct(digest(u).alias("d"), F.lit(u).alias("url")) for u in HOSTS])))
    return keys.select("user_id", F.posexplode(ranked).alias("p", "r")).select("user_id", F.col("r.url").alias("url"), (F.col("p") + 1).cast("bigint").alias("rank"))


@built("hrw_pick", "SELECT user_id, arg_max(url, sha256(concat(user_id::STRING, '|', url))) AS url FROM (SELECT DISTINCT user_id FROM events) u, (VALUES ('http://a:1'), ('http://b:2'), ('http://c:3')) AS h(url) GROUP BY user_id")
def _hrw_pick(spark, sf_dir):
    return _hrw_rank(spark, sf_dir).where("rank = 1").select("user_id", "url")


@built("lock_objid", "SELECT user_id, CAST(CASE WHEN x >= 2147483648 THEN x - 4294967296 ELSE x END AS BIGINT) AS objid FROM (SELECT user_id, ('0x' || substr(sha1(concat('t', chr(0), user_id::STRING)), 1, 8))::BIGINT AS x FROM (SELECT DISTINCT user_id FROM events) u) t")
def _lock(spark, sf_dir):
    keys = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct()
    x = F.conv(F.substring(F.sha1(F.concat(F.lit("t"), F.char(F.lit(0)), F.col("user_id").cast("string"))), 1, 8), 16, 10).cast("bigint")
    return keys.select("user_id", F.when(x >= 2**31, x - 2**32).otherwise(x).alias("objid"))


@built("shard_uri_parse", "SELECT event_id, regexp_extract(uri, '([0-9]+)-([0-9a-f]{16})[.]bin$', 1) AS shard, regexp_extract(uri, '([0-9]+)-([0-9a-f]{16})[.]bin$', 2) AS digest FROM (SELECT event_id, concat('s3://x/', event_id::STRING, '-', substr(sha256(event_id::STRING), 1, 16), '.bin') AS uri FROM events) t")
def _uri(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    uri = F.concat(F.lit("s3://x/"), F.col("event_id").cast("string"), F.lit("-"), F.substring(F.sha2(F.col("event_id").cast("string"), 256), 1, 16), F.lit(".bin"))
    form = r"([0-9]+)-([0-9a-f]{16})[.]bin$"
    return rows.select("event_id", F.regexp_extract(uri, form, 1).alias("shard"), F.regexp_extract(uri, form, 2).alias("digest"))


LINES = """SELECT event_id AS line, CASE event_id % 14 WHEN 0 THEN '{not json' WHEN 1 THEN '[1, 2]' WHEN 2 THEN '{"id": "", "values": [1, 2]}'
 WHEN 3 THEN '{"id": 7, "values": [1, 2]}' WHEN 4 THEN concat('{"id": "', repeat('x', 257), '", "values": [1, 2]}') WHEN 5 THEN '{"id": "a", "values": [1, true]}'
 WHEN 6 THEN '{"id": "a", "values": [1, "2"]}' WHEN 7 THEN '{"id": "a", "values": [1, 2, 3]}' WHEN 8 THEN '{"id": "a", "values": [1, 1e39]}'
 WHEN 9 THEN '{"id": "a", "values": [1, 2], "metadata": [1]}' WHEN 10 THEN '{"id": "a", "values": [1, 2], "metadata": null}' WHEN 11 THEN '  '
 WHEN 12 THEN '{"id": "a", "values": "1, 2"}' ELSE concat('{"id": "', event_type, '", "values": [', CAST(event_id AS STRING), ', 2.5], "metadata": {"k": 1}}') END AS text FROM events"""


def _line_checks(name: str, strict: bool) -> None:
    kinds = "'UBIGINT', 'BIGINT', 'DOUBLE'" + ("" if strict else ", 'BOOLEAN'")
    oracle = f"""WITH l AS ({LINES}), p AS (SELECT line, json_valid(text) AS good, CASE WHEN json_valid(text) THEN text ELSE 'null' END AS d FROM l WHERE length(trim(text)) > 0)
SELECT line, CASE WHEN NOT good THEN 'invalid_json' WHEN json_type(d) <> 'OBJECT' THEN 'not_object'
 WHEN coalesce(json_type(d, '$.id'), '') <> 'VARCHAR' OR json_extract_string(d, '$.id') = '' THEN 'invalid_id'
 WHEN {str(strict).lower()} AND length(json_extract_string(d, '$.id')) > 256 THEN 'id_too_long'
 WHEN coalesce(json_type(d, '$.values'), '') <> 'ARRAY' OR len(list_filter(json_extract(d, '$.values[*]'), lambda x: json_type(x) NOT IN ({kinds}))) > 0 THEN 'invalid_values'
 WHEN json_array_length(d, '$.values') <> 2 THEN 'dimension_mismatch'
 WHEN {str(strict).lower()} AND len(list_filter(json_extract(d, '$.values[*]'), lambda x: abs(CAST(x AS DOUBLE)) > {imports.LARGEST})) > 0 THEN 'out_of_range'
 WHEN coalesce(json_type(d, '$.metadata'), 'NULL') NOT IN ('NULL', 'OBJECT') THEN 'invalid_metadata' END AS reason FROM p"""

    @built(name, oracle)
    def run(spark, sf_dir):
        _views(spark, sf_dir, ("events",))
        return imports.checked(spark.sql(LINES), 2, strict).select("line", "reason")


_line_checks("ndjson_validate", True)
_line_checks("import_validate", False)


@built("metadata_merge", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'patched' ELSE event_type END AS kind, user_id::STRING AS owner, CASE WHEN event_id % 2 = 0 THEN 'x' END AS note, CAST(2 + (event_id % 2 = 0)::INT AS INT) AS n FROM events")
def _merge(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    base = F.create_map(F.lit("kind"), F.col("event_type"), F.lit("owner"), F.col("user_id").cast("string"))
    patch = X.merged(F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("kind"), F.lit("patched"))), F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("note"), F.lit("x"))))
    both = rows.select("event_id", X.merged(base, patch).alias("m"))
    return both.select("event_id", *[F.try_element_at("m", F.lit(k)).alias(k) for k in ("kind", "owner", "note")], F.size("m").alias("n"))


def _engine(spark, sf_dir):
    """A dataset that was written, partly deleted, consolidated and written again."""
    root = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/ferrule-scratch"
    engine, rows = Engine(spark, f"{root.rstrip('/')}/engine-{uuid.uuid4().hex}"), records(spark, sf_dir)
    engine.create("vectors", len(one_vector(spark, sf_dir)))
    engine.upsert("vectors", rows.select("id", "values", "metadata"))
    engine.delete("vectors", rows.where("vec_id % 17 = 0").select("id"))
    engine.consolidate("vectors")
    again = rows.where("vec_id % 7 = 0").withColumn("label", F.col("label") + 10)
    engine.upsert("vectors", again.select("id", "values", F.to_json(F.struct("label")).alias("metadata")))
    return engine


ENGINE_STATE = "SELECT vec_id, concat('v', vec_id::STRING) AS id, CASE WHEN vec_id % 7 = 0 THEN label + 10 ELSE label END AS label FROM embeddings WHERE vec_id % 17 <> 0 OR vec_id % 7 = 0"


@built("engine_state", f"SELECT id, label FROM ({ENGINE_STATE}) t")
def _engine_state(spark, sf_dir):
    return _engine(spark, sf_dir).state("vectors").select("id", F.get_json_object("metadata", "$.label").cast("int").alias("label"))


@built("engine_query", f"SELECT id, round(d, 6) AS score FROM (SELECT id, {DISTANCE.format(a='e.embedding', b=ONE)} AS d FROM ({ENGINE_STATE}) t JOIN embeddings e USING (vec_id) WHERE t.label = 3) u ORDER BY d, id LIMIT 10")
def _engine_query(spark, sf_dir):
    hits = _engine(spark, sf_dir).query("vectors", one_vector(spark, sf_dir), 10, {"label": 3})
    return rounded(spark.createDataFrame([(h["id"], h["score"]) for h in hits], "id string, score double"))
