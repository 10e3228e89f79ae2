"""Every core query against its oracle statement on DuckDB."""

import glob
import os

import duckdb
import numpy as np
import pytest

from ferrule.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, oracle, name):
    ours, theirs = QUERIES[name](spark, DATA).toPandas(), oracle.execute(ORACLE_SQL[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    assert sorted(map(tuple, ours[columns].astype(str).values)) == sorted(map(tuple, theirs[columns].astype(str).values))


def test_pruned_search_finds_the_nearest(spark):
    rows = [r["recall"] for r in QUERIES["ivf_recall"](spark, "/root/testdata/sf0.1").collect()]
    assert len(rows) == 20 and sum(rows) / len(rows) >= 0.9


def test_entry_point_imports():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["latest_shard", "generations", "frontier_watermark", "dataset_watermark", "grace_watermark", "superseded_shards", "watermark_carry"])
def test_generation_rules_on_other_shards(spark, name):
    """Chains with gaps, overlaps, other quantizers and lost parents against the oracle's statement."""
    import random

    from ferrule import queries

    random.seed(6)
    rows, bases = [], {}
    for shard in range(1, 160):
        dataset = random.choice("abcde")
        if shard < 12 or random.random() < 0.2:
            hi = random.choice([0, 10 * shard])
            rows.append((shard, dataset, 0, 0, random.choice(["q1", "q2"]), 0, hi, 5 * shard, shard))
            bases[shard] = [rows[-1], hi or 5 * shard]
        else:
            base = random.choice(list(bases))
            row, at = bases[base]
            lo = at + random.choice([1, 1, 1, 1, 0, 3])
            parent, quantizer = random.choice([base] * 9 + [9999]), random.choice([row[4]] * 9 + ["q9"])
            rows.append((shard, row[1], 1, parent, quantizer, lo, lo + 7, 0, shard))
            bases[base][1] = lo + 7
    shards = spark.createDataFrame(rows, "shard int, dataset string, level int, parent int, quantizer string, lo int, hi int, consolidated int, created int")
    con = duckdb.connect()
    con.register("given", shards.toPandas())
    got = queries.OVER_SHARDS[name](shards).toPandas()
    want = con.execute(ORACLE_SQL[name].replace(queries.SHARDS, "shards AS (SELECT * FROM given)")).df()
    columns = sorted(got.columns)
    assert len(want) and columns == sorted(want.columns)
    assert sorted(map(tuple, got[columns].astype(str).values)) == sorted(map(tuple, want[columns].astype(str).values))


def test_import_queries_check_their_lines(spark, monkeypatch):
    from ferrule.sources import imports

    calls, real = [], imports.checked
    monkeypatch.setattr(imports, "checked", lambda *a, **b: calls.append(a) or real(*a, **b))
    for name in ("import_counters", "import_policy", "import_rejected"):
        QUERIES[name](spark, DATA)
    assert len(calls) == 3


def test_near_and_bad_vectors(spark):
    """Distances far below six digits are told apart; records that have no distance are never found."""
    from ferrule.operators import search
    from ferrule.plans import cells

    rows = [("a", [3e-4, 0.0]), ("b", [2e-4, 0.0]), ("c", [0.0, 0.0]), ("d", None), ("e", [1.0]), ("f", [float("nan"), 0.0]), ("g", [None, 0.0]), ("h", [float("inf"), 0.0]), ("i", [0.0, 3e-4]), ("j", [1e6, 1e6])]
    table = spark.createDataFrame(rows, "id string, values array<float>")
    want = ["c", "b", "a", "i", "j"]
    assert [r["id"] for r in search.knn(table, [0.0, 0.0], 2).collect()] == want[:2]
    assert [r["id"] for r in search.knn(table.where("id <> 'h'"), [0.0, 0.0], 9).collect()] == want
    queries = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1e6, 1e6]), (3, None)], "qid int, query array<float>")
    for k in (1, 3, 9):
        found = search.knn_batch(table, queries, k).orderBy("qid", "rank").collect()
        assert [r["id"] for r in found if r["qid"] == 1] == want[:k] and [r["id"] for r in found if r["qid"] == 2][0] == "j" and {r["qid"] for r in found} == {1, 2}
    placed = cells.assign(table, np.array([[0, 0], [1e6, 1e6]], np.float32))
    assert [r["id"] for r in search.probe(placed, np.array([[0, 0], [1e6, 1e6]], np.float32), queries.where("qid = 1"), 1, 9).orderBy("rank").collect()] == want[:4]
    none = spark.createDataFrame([], table.schema)
    assert search.knn_batch(none, queries, 3).count() == 0 and search.knn_batch(table, queries.where("false"), 3).count() == 0 and len(cells.train(none)) == 0


def test_batch_search_equals_plain_search(spark):
    rng = np.random.default_rng(4)
    vectors = np.round(rng.normal(size=(700, 8)), 1).astype(np.float32)  # ties happen
    table = spark.createDataFrame([(f"v{i}", v.tolist()) for i, v in enumerate(vectors)], "id string, values array<float>").repartition(5)
    asked = [(i, vectors[i].tolist()) for i in range(0, 700, 50)]
    from ferrule.operators import search

    found = search.knn_batch(table, spark.createDataFrame(asked, "qid int, query array<float>"), 7).orderBy("qid", "rank").collect()
    for q, vector in asked:
        score = ((vectors.astype(float) - np.array(vector, np.float32).astype(float)) ** 2).sum(1)
        want = sorted((s, f"v{i}") for i, s in enumerate(score))[:7]
        got = [(r["score"], r["id"]) for r in found if r["qid"] == q]
        assert [i for _, i in got] == [i for _, i in want] and np.allclose([s for s, _ in got], [s for s, _ in want])


def test_engine_probes_enough_cells(spark, tmp_path):
    from ferrule.engine import Engine
    from ferrule.queries import records

    engine, rows = Engine(spark, str(tmp_path)), records(spark, "/root/testdata/sf0.1")
    dimension = len(rows.first()["values"])
    engine.create("d", dimension)
    engine.upsert("d", rows.select("id", "values", "metadata"))
    assert engine.consolidate("d") == "full"
    base = engine.describe("d")["base"]
    assert base["cells"] > base["probed"] >= 64
    held = {r["id"]: np.array(r["values"], float) for r in rows.collect()}
    names, matrix = list(held), np.array(list(held.values()))
    shares = []
    for at in range(0, len(names), 300):
        vector = matrix[at] + 0.01
        exact = {names[i] for i in np.argsort(((matrix - vector) ** 2).sum(1))[:10]}
        shares.append(len(exact & {r["id"] for r in engine.query("d", vector.tolist(), 10)}) / 10)
    assert sum(shares) / len(shares) >= 0.9


def held_at_most(run):
    """What a call gives, and the MB that it held at once."""
    import tracemalloc

    tracemalloc.start()
    try:
        return run(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_cells_of_a_batch_take_bounded_memory():
    """The distances of 10000 vectors to 4096 cells alone are 328 MB."""
    from ferrule.plans import cells

    rng = np.random.default_rng(5)
    vectors, centroids = rng.normal(size=(10000, 8)), rng.normal(size=(4096, 8)).astype(np.float32)
    for n in (1, 3):
        near, mb = held_at_most(lambda n=n: cells.nearest(vectors, centroids, n))
        assert mb < 60 and near.shape == (10000, n)
        for at in (0, 255, 256, 9999):
            assert list(near[at]) == list(np.argsort(((centroids.astype(float) - vectors[at]) ** 2).sum(1))[:n])


def test_distances_of_a_batch_take_bounded_memory():
    """The distances of 10000 records to 1000 queries alone are 80 MB; equal distances go by row."""
    from ferrule.operators import search

    rng = np.random.default_rng(6)
    vectors = np.round(rng.normal(size=(10000, 4)), 1)
    (q, r, score), mb = held_at_most(lambda: search._best(vectors, vectors[:1000], 10))
    assert mb < 60 and len(q) == 10000
    for ask in (0, 500, 999):
        exact = ((vectors - vectors[ask]) ** 2).sum(1)
        assert sorted(zip(score[q == ask], r[q == ask], strict=True)) == sorted(zip(exact, range(10000), strict=True))[:10]


def test_a_task_hands_on_no_more_than_the_nearest(spark, monkeypatch):
    """Over several batches and cells, and for pruned, full and exact search: k rows of a query, the right ones."""
    from ferrule.operators import search
    from ferrule.plans import cells

    rng = np.random.default_rng(7)
    vectors = np.round(rng.normal(size=(3000, 4)), 1).astype(np.float32)  # ties happen
    centroids = vectors[:40]
    table = spark.createDataFrame([(f"v{i}", v.tolist()) for i, v in enumerate(vectors)], "id string, values array<float>").repartition(2)
    placed, queries = cells.assign(table, centroids), spark.createDataFrame([(i, vectors[i].tolist()) for i in range(0, 3000, 100)], "qid int, query array<float>")
    cell = cells.nearest(vectors.astype(float), centroids, 1)[:, 0]
    handed, real = [], type(table).mapInArrow
    monkeypatch.setattr(type(table), "mapInArrow", lambda *args: handed.append(real(*args)) or handed[-1])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "200")
    try:
        for nprobe in (0, 5, 40):
            found = search.probe(placed, centroids, queries, nprobe, 7) if nprobe else search.knn_batch(table, queries, 7)
            assert handed[-1].count() <= table.rdd.getNumPartitions() * queries.count() * 7
            got = {}
            for row in found.orderBy("qid", "rank").collect():
                got.setdefault(row["qid"], []).append(row["id"])
            for i in range(0, 3000, 100):
                near = cells.nearest(vectors[i : i + 1].astype(float), centroids, nprobe or 40)[0]
                score = ((vectors.astype(float) - vectors[i].astype(float)) ** 2).sum(1)
                assert got[i] == [n for _, n in sorted((score[j], f"v{j}") for j in range(3000) if cell[j] in near)[:7]]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
