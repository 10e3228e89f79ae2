"""The dataset engine against a plain dictionary of records."""

import json
import random

import pytest

from ferrule.engine import Engine
from ferrule.functions.control import DailyQuota, TokenBucket, decode_cursor, encode_cursor, ranked_hosts
from ferrule.sources.imports import numbered_lines


def frame(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v], json.dumps(m)) for i, v, m in rows], "id string, values array<float>, metadata string")


def held(engine, name):
    return {r["id"]: (list(r["values"]), json.loads(r["metadata"])) for r in engine.state(name).collect()}


def nearest(records, vector, k, wanted=None):
    scored = [(sum((a - b) ** 2 for a, b in zip(v, vector, strict=True)), i) for i, (v, m) in records.items() if not wanted or all(m.get(x) == y for x, y in wanted.items())]
    return [i for _, i in sorted(scored)[:k]]


def test_life_of_a_dataset(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("ferrule.engine.MAX_DELTAS", 1)
    engine, want = Engine(spark, str(tmp_path)), {}
    engine.create("d", 4)
    with pytest.raises(ValueError, match="dataset_exists"):
        engine.create("d", 4)
    assert engine.query("d", [0, 0, 0, 0]) == [] and engine.consolidate("d") == "noop"
    random.seed(1)
    for number, kind in enumerate(["full", "delta", "major"]):
        rows = [(f"v{random.randint(0, 300)}", [random.random() for _ in range(4)], {"n": i % 3, "round": number}) for i in range(150)]
        engine.upsert("d", frame(spark, rows))
        for i, v, m in rows:
            want[i] = (v, m)
        gone = [f"v{i}" for i in range(number, 300, 7)]
        engine.delete("d", spark.createDataFrame([(i,) for i in gone], "id string"))
        for i in gone:
            want.pop(i, None)
        for _ in range(2):  # before and after the fold
            found = held(engine, "d")
            assert found.keys() == want.keys() and all(found[i][1] == want[i][1] and found[i][0] == pytest.approx(want[i][0]) for i in want)
            assert [r["id"] for r in engine.query("d", [0.5] * 4, 5)] == nearest(want, [0.5] * 4, 5)
            assert [r["id"] for r in engine.query("d", [0.5] * 4, 200, {"n": 1})] == nearest(want, [0.5] * 4, 200, {"n": 1})
            if _ == 0:
                assert engine.consolidate("d") == kind
    first = engine.page("d", 100)
    second = engine.page("d", 1000, first["next_cursor"])
    assert [r["id"] for r in first["vectors"] + second["vectors"]] == sorted(want) and second["next_cursor"] is None
    one = sorted(want)[0]
    assert engine.get("d", one)["metadata"] == want[one][1] and engine.get("d", "none") is None
    engine.delete("d", spark.createDataFrame([(one,)], "id string"))
    assert engine.lookup("d", one) == ("tombstone", None) and engine.lookup("d", "none") == ("absent", None)
    engine.upsert("d", frame(spark, [(one, *want[one])]))
    assert engine.lookup("d", one)[0] == "live"
    assert engine.sweep("d", 1) > 0 and engine.sweep("d", 1) == 0
    assert held(engine, "d").keys() == want.keys() and engine.count("d") == len(want)
    assert [d["name"] for d in engine.datasets()] == ["d"]
    engine.drop("d")
    with pytest.raises(KeyError):
        engine.get("d", one)
    engine.create("d", 4)
    assert engine.count("d") == 0


def test_order_within_a_batch_and_bad_records(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    done = engine.create("d", 1)
    done = engine.upsert("d", frame(spark, [("a", [i], {"i": i}) for i in range(50)]).repartition(1).coalesce(1))
    assert done["next_lsn"] == 51 and engine.get("d", "a")["metadata"] == {"i": 49}
    assert engine.state("d").first()["lsn"] == 50
    for bad in ([("a", [1, 2], {})], [("", [1], {})], [("a", [float("nan")], {})], [("a", [float("inf")], {})]):
        with pytest.raises(ValueError, match="invalid_record"):
            engine.upsert("d", frame(spark, bad))
    assert engine.describe("d")["version"] == done["version"]


def test_lost_commits_are_applied_again(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    engine.create("d", 1)
    chain, calls = engine._chain("d"), []

    def change(now):
        calls.append(now["version"])
        if len(calls) == 1:  # another writer comes first
            engine.upsert("d", frame(spark, [("x", [1], {})]))
        return now | {"note": 1}

    done = chain.commit(change)
    assert calls == [1, 2] and done["version"] == 3 and len(done["log"]) == 1


def test_imports(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"))
    engine.create("d", 2)
    path = tmp_path / "in.ndjson"
    path.write_text('{"id":"a","values":[1,2]}\n\n{not json\n{"id":"b","values":[1]}\n{"id":"c","values":[3,4],"metadata":{"k":1}}\n')
    assert {r["line"]: r["text"][:5] for r in numbered_lines(spark, str(path)).collect()} == {1: '{"id"', 2: "", 3: "{not ", 4: '{"id"', 5: '{"id"'}
    got = engine.import_lines("d", str(path))
    assert (got["processed"], got["accepted"], got["rejected"], got["first_bad"], got["failed"]) == (4, 2, 2, 3, False)
    assert held(engine, "d") == {"a": ([1.0, 2.0], {}), "c": ([3.0, 4.0], {"k": 1})}
    assert engine.import_lines("d", str(path), max_bad=1)["failed"] and engine.import_lines("d", str(path), abort=True)["failed"]
    spark.createDataFrame([("e", [5.0, 6.0])], "id string, values array<double>").write.parquet(str(tmp_path / "p"))
    assert engine.import_parquet("d", str(tmp_path / "p"))["accepted"] == 1 and engine.count("d") == 3
    spark.createDataFrame([("e", [5.0], 1)], "id string, values array<double>, more int").write.parquet(str(tmp_path / "q"))
    with pytest.raises(ValueError, match="invalid_schema"):
        engine.import_parquet("d", str(tmp_path / "q"))


def test_control():
    now = [0.0]
    bucket = TokenBucket(1, 2, lambda: now[0])
    assert [bucket.take() for _ in range(3)] == [True, True, False]
    now[0] = 1.0
    assert bucket.take() and not bucket.take()
    day = ["a"]
    quota = DailyQuota(3, lambda: day[0])
    assert quota.charge(2) and not quota.charge(2) and quota.charge(1)
    day[0] = "b"
    assert quota.charge(3)
    assert decode_cursor(encode_cursor("é7")) == "é7" and decode_cursor(None) is None
    for bad in ("?", "e30=", encode_cursor(-1)):
        with pytest.raises(ValueError, match="invalid_cursor"):
            decode_cursor(bad)
    assert sorted(ranked_hosts("t", ["a", "b", "c"])) == ["a", "b", "c"]


def test_memory(spark, tmp_path):
    from ferrule.memory import Memory

    memory = Memory(Engine(spark, str(tmp_path)), "m", 2)
    memory.insert([[0, 0], [1, 0], [3, 0]], [{"u": "a"}, {"u": "b"}, {"u": "a"}], ["x", "y", "z"])
    assert [(h["id"], h["score"]) for h in memory.search([0, 0], 2)] == [("x", 1.0), ("y", 0.5)]
    assert [h["id"] for h in memory.search([0, 0], 5, {"u": "a", "v": None})] == ["x", "z"]
    memory.update("x", payload={"w": 1})
    memory.delete("y")
    assert memory.get("x")["metadata"] == {"u": "a", "w": 1} and memory.get("y") is None
    assert [h["id"] for h in memory.list({"u": "a"})] == ["x", "z"] and memory.col_info()["count"] == 2
    memory.reset()
    assert memory.list() == [] and memory.keyword_search("q") is None
