"""Record lines: checks in order, a job's outcome, and ingest that survives a second run."""

from ferrule.sources.imports import checked, outcome
from ferrule.streaming.ingest import ingest

LINES = [
    '{"id":"oak","values":[0.5,0,-1,8],"metadata":{"leaf":"lobed"}}', '{"id":"elm","values":[1,1', "", '{"id":["fir"],"values":[3,1,4,1]}', " \t", '{"id":"yew","values":[2,7,1,8,2]}',
    '{"id":"ash","values":{"a":1}}', '{"values":[6,6,6,6],"id":"box"}',
]


def test_reasons(spark):
    rows = checked(spark.createDataFrame(list(enumerate(LINES, 1)), "line bigint, text string"), 4)
    found = {r["line"]: r["reason"] for r in rows.collect()}
    assert found == {1: None, 2: "invalid_json", 4: "invalid_id", 6: "dimension_mismatch", 7: "invalid_values", 8: None}
    got = outcome(rows, abort=False, max_bad=3).first()
    assert (got["processed"], got["accepted"], got["rejected"], got["first_bad"], got["failed"]) == (6, 2, 4, 2, True)
    assert outcome(rows, abort=False).first()["failed"] is False


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_text("\n".join(LINES))
    for _ in range(2):
        ingest(spark, str(source), f"{tmp_path}/log", f"{tmp_path}/bad", f"{tmp_path}/checkpoint", 4).awaitTermination()
    assert {r["id"] for r in spark.read.parquet(f"{tmp_path}/log").collect()} == {"oak", "box"}
    assert spark.read.json(f"{tmp_path}/bad").count() == 4


def test_feed_takes_each_batch_once(spark, tmp_path):
    from ferrule.engine import Engine
    from ferrule.streaming.ingest import feed

    engine, source = Engine(spark, str(tmp_path / "store")), tmp_path / "in"
    engine.create("d", 4)
    source.mkdir()
    for number in range(2):
        (source / f"{number}.txt").write_text("\n".join(LINES))
        feed(engine, "d", str(source), str(tmp_path / "checkpoint"), most_rows=3).awaitTermination()
    now = engine.describe("d")
    assert now["next_lsn"] == 5 and now["base"] and not now["log"]
    assert engine.upsert("d", spark.createDataFrame([("z", [1.0] * 4)], "id string, values array<float>"), (str(tmp_path / "checkpoint"), 1))["version"] == now["version"]
    assert {r["id"] for r in engine.state("d").collect()} == {"oak", "box"}


def test_json_files_and_endings(spark, tmp_path):
    import json

    from ferrule.engine import Engine
    from ferrule.sources.imports import kind_of, lines_of

    assert [kind_of(x) for x in ("a/B.JSONL", "x.ndjson", "x.json", "x.parquet/", "x.csv", "json")] == ["jsonl", "jsonl", "json", "parquet", "unknown", "unknown"]
    (tmp_path / "many.json").write_text(json.dumps([{"id": "a", "values": [1, 2]}, {"id": "b", "values": [3]}, 7], indent=1))
    (tmp_path / "one.json").write_text('{"id": "c", "values": [5, 6]}')
    assert [(r["line"], json.loads(r["text"])) for r in lines_of(spark, str(tmp_path / "many.json"), "json").orderBy("line").collect()][2] == (3, 7)
    engine = Engine(spark, str(tmp_path / "store"))
    engine.create("d", 2)
    got = engine.import_file("d", str(tmp_path / "many.json"))
    assert (got["accepted"], got["rejected"], got["first_bad"]) == (1, 2, 2) and engine.import_file("d", str(tmp_path / "one.json"))["accepted"] == 1
    assert {r["id"] for r in engine.state("d").collect()} == {"a", "c"}
