"""Requests around the engine: query checks, jobs, queue, results, accounts, times and names."""

import json

import pytest

from ferrule.functions import control
from ferrule.service import ATTEMPTS, LOST, RESULT_TTL, STUCK, TOKEN_TTL, Accounts, Queue, Refused, Results, Service
from ferrule.sources import uri
from ferrule.sources.manifest import Files


class Clock:
    now = 1_700_000_000.0

    def __call__(self):
        return self.now


def frame(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v], json.dumps(m)) for i, v, m in rows], "id string, values array<float>, metadata string")


def test_query_bodies_are_checked_in_order(spark, tmp_path):
    service = Service(spark, str(tmp_path))
    service.engine.create("d", 2)
    good = {"dataset": "d", "vector": [1, 2.5]}
    cases = [
        ([], "invalid_request"), ({"dataset": ""}, "dataset_not_found"), (good | {"dataset": "e"}, "dataset_not_found"), (good | {"vector": "x"}, "invalid_request"),
        (good | {"vector": [1, True]}, "invalid_request"), (good | {"vector": [1]}, "dimension_mismatch"), (good | {"top_k": 0}, "top_k_out_of_range"), (good | {"top_k": True}, "top_k_out_of_range"),
        (good | {"top_k": 1001}, "top_k_out_of_range"), (good | {"nprobe": 0}, "invalid_request"), (good | {"nprobe": 1025}, "nprobe_out_of_range"), (good | {"filter": []}, "invalid_request"),
        (good | {"filter": {"a": {"b": 1}}}, "invalid_request"), (good | {"vector": [1], "top_k": 0}, "dimension_mismatch"),
    ]
    for body, code in cases:
        with pytest.raises(Refused, match=code):
            service.query(body)
    assert service.query(good | {"top_k": None, "filter": {}})["matches"] == []
    # tenants see nothing of each other
    with pytest.raises(Refused, match="dataset_not_found"):
        Service(spark, str(tmp_path), "other").query(good)


def test_queue_delivers_until_acknowledged(spark, tmp_path):
    clock = Clock()
    queue = Queue(Files(spark, str(tmp_path)), clock)
    for n in range(2):
        clock.now += 1
        queue.publish("t", {"n": n})
    first = queue.consume("t")
    assert first["body"] == {"n": 0} and queue.consume("t")["body"] == {"n": 1} and queue.consume("t") is None
    clock.now += LOST
    assert queue.reclaim("t") == 2 and queue.nack(first) is False
    for attempt in range(2, ATTEMPTS + 1):
        message = queue.consume("t")
        assert message["body"] == {"n": 0} and message["attempt"] == attempt
        assert queue.nack(message) is (attempt == ATTEMPTS)
    assert [m["body"] for m in queue.dead("t")] == [{"n": 0}]
    message = queue.consume("t")
    assert message["body"] == {"n": 1}
    queue.ack(message)
    assert queue.consume("t") is None


def test_import_jobs_and_queued_queries(spark, tmp_path):
    clock = Clock()
    service = Service(spark, str(tmp_path), clock=clock)
    service.engine.create("d", 2)
    for bad, code in ((("e", "ndjson"), "dataset_not_found"), (("d", "csv"), "invalid_format"), (("d", "ndjson", "skip"), "invalid_error_mode"), (("d", "ndjson", "abort", -1), "invalid_max_bad_records")):
        with pytest.raises(Refused, match=code):
            service.create_import(*bad)
    made = service.create_import("d", "ndjson")
    clock.now += 1
    failing = service.create_import("d", "ndjson", "abort")
    assert made["status"] == "awaiting_upload" and made["upload"]["method"] == "PUT" and [j["import_id"] for j in service.imports("d")] == [failing["import_id"], made["import_id"]]
    with pytest.raises(Refused, match="upload_missing"):
        service.complete_import("d", made["import_id"])
    lines = b'{"id":"near","values":[0,1]}\n\t \n{"id":"far","values":[5,5],"metadata":{"k":1}}\n{"id":"bad","values":[1]}\n'
    for job in (made, failing):
        service.engine.files.write_bytes(job["upload"]["url"], lines)
        assert service.complete_import("d", job["import_id"])["percent_complete"] == 25
    with pytest.raises(Refused, match="invalid_state"):
        service.complete_import("d", made["import_id"])
    key = service.submit({"dataset": "d", "vector": [0, 0], "top_k": 1})
    assert service.status(key) == {"ready": False} and service.status("nothing") == {"ready": False}
    assert service.work() == 3
    done, failed = (service.import_job("d", j["import_id"]) for j in (made, failing))
    assert (done["status"], done["records_processed"], done["records_accepted"], done["records_rejected"], done["percent_complete"]) == ("completed", 3, 2, 1, 100)
    assert failed["status"] == "failed" and "line 4" in failed["error_message"]
    assert [r["text"] for r in spark.read.json(done["rejected_records_url"]).collect()] == ['{"id":"bad","values":[1]}']
    service.submit({"dataset": "d", "vector": [0, 0], "top_k": 1})
    key = service.submit({"dataset": "d", "vector": [0, 0], "top_k": 1})
    service.work()
    assert [m["id"] for m in service.status(key)["matches"]] == ["near"]
    clock.now += RESULT_TTL
    assert service.status(key) == {"ready": False}
    told = service.tick()
    assert told["uploads"] == 2 and told["results"] == 3 and service.tick()["uploads"] == 0
    assert {r["id"] for r in service.by_native_id("d").collect()} == {"near", "far"}
    with pytest.raises(Refused, match="import_not_found"):
        service.import_job("d", "imp_x")


def test_idle_logs_are_folded_and_stuck_datasets_fail(spark, tmp_path):
    clock = Clock()
    service = Service(spark, str(tmp_path), clock=clock)
    engine = service.engine
    engine.create("d", 1)
    engine.upsert("d", frame(spark, [("a", [1], {})]))
    assert not engine.due("d") and service.tick()["due"] == 0
    clock.now += 60
    assert service.tick()["due"] == 1 and service.work() == 1
    assert engine.summary("d")["status"] == "indexed" and engine.summary("d")["row_count"] == 1 and engine.summary("d")["last_indexed_at"].endswith("Z")
    engine.upsert("d", frame(spark, [("b", [1], {})]))
    clock.now += STUCK
    assert engine.fail_if_stale("d", STUCK, "late") and engine.describe("d")["status"] == "error" and not engine.fail_if_stale("d", STUCK, "late")
    engine.consolidate("d")
    assert engine.summary("d")["error_message"] is None


def test_landed_parts_are_built_once(spark, tmp_path):
    clock = Clock()
    engine = Service(spark, str(tmp_path), clock=clock).engine
    engine.create("d", 1)
    assert engine.build("d") == "noop"
    for value in (1, 2):
        clock.now += 1
        engine.land("d", frame(spark, [("a", [value], {}), (f"v{value}", [value], {})]))
    assert engine.build("d") == "full" and engine.build("d") == "noop"
    assert engine.get("d", "a")["values"] == [2.0] and engine.count("d") == 3
    clock.now += 1
    engine.land("d", frame(spark, [("a", [3], {})]))
    assert engine.build("d") == "incremental" and engine.get("d", "a")["values"] == [3.0]
    assert engine.sweep_landed("d") == 3 and engine.landed("d") == [] and engine.build("d") == "noop"
    clock.now += 1
    engine.land("d", frame(spark, [("a", [3, 4], {})]))
    assert engine.build("d") == "error" and engine.describe("d")["status"] == "error"


def test_accounts(spark, tmp_path):
    clock = Clock()
    accounts = Accounts(Files(spark, str(tmp_path)), b"secret", clock)
    made = accounts.signup("A@b.c", "password")
    tenant = made["id"]
    with pytest.raises(Refused, match="email_taken"):
        accounts.signup("a@B.c", "password")
    token = accounts.login("a@b.c", "password")
    for bad in (("a@b.c", "wrong"), ("x@b.c", "password")):
        with pytest.raises(Refused, match="unauthorized"):
            accounts.login(*bad)
    assert accounts.owner(token) == tenant and accounts.owner(token[:-2] + "xx") is None and accounts.owner("x") is None
    assert Accounts(Files(spark, str(tmp_path)), b"other", clock).owner(token) is None
    clock.now += TOKEN_TTL
    assert accounts.owner(token) is None
    key = accounts.create_key(tenant, "first")
    assert accounts.owner(key["key"]) == tenant and "key" not in accounts.list_keys(tenant)[0] and accounts.list_keys(tenant)[0]["last_used_at"]
    accounts.revoke_key(tenant, key["id"])
    assert accounts.owner(key["key"]) is None and accounts.list_keys("other") == []
    assert accounts.charge_vectors(tenant, 99_999) and not accounts.charge_vectors(tenant, 2) and accounts.charge_vectors(tenant, 1)
    assert accounts.charge_query(tenant, 1) and not accounts.charge_query(tenant, 1)
    assert accounts.usage(tenant)["queries_today"] == 1
    clock.now += 24 * 3600
    assert accounts.usage(tenant)["queries_today"] == 0 and accounts.charge_query(tenant, 1) and not accounts.charge_query("nobody", 1)


def test_results_hold_for_a_while(spark, tmp_path):
    clock = Clock()
    results = Results(Files(spark, str(tmp_path)), clock)
    results.put("a", {"x": 1})
    assert results.get("a") == {"x": 1} and results.get("b") is None and results.sweep() == 0
    clock.now += RESULT_TTL
    assert results.get("a") is None and results.sweep() == 1


def test_names_times_and_errors():
    made = uri.shard_uri("bucket", "t", "d", "shard-1-x", b"content")
    assert uri.parse(made) == {"bucket": "bucket", "tenant": "t", "dataset": "d", "shard": "shard-1-x", "digest": uri.content_digest(b"content")}
    old = uri.dated_uri("s3://bucket/p", "t", "d", "shard-1.bin", 0)
    assert old == "s3://bucket/p/t/d/indexes/1970-01-01/shard-1.bin" and uri.is_legacy(old) and not uri.is_legacy(made) and not uri.is_legacy("s3://a/b.bin") and not uri.is_legacy(None)
    for bad in (old, "s3://b/t/d/x-0123.bin", "http://b/t/d/x-0123456789abcdef.bin", None):
        with pytest.raises(ValueError, match="invalid_shard_uri"):
            uri.parse(bad)
    assert control.iso_time(0) == "1970-01-01T00:00:00Z" and control.parse_iso("1970-01-01T00:00:00Z").timestamp() == 0 == control.parse_iso("1970-01-01T00:00:00").timestamp()
    assert control.parse_iso("x") is None and control.parse_iso(None) is None
    assert control.is_on(" YES ") and not control.is_on("") and control.is_on("", bare=True) and not control.is_on(None, bare=True) and not control.is_on("0")
    codes = [(PermissionError(), "cache_unavailable"), (FileNotFoundError(), "storage_unavailable"), (OSError(), "cache_unavailable"), (control.StoreTimeout(), "storage_unavailable"), (control.CacheFull(), "cache_capacity_exceeded"), (control.RecentUnavailable(), "recall_unavailable"), (KeyError("secret"), "ephemeral_error")]
    for error, code in codes:
        assert control.error_code(error)[0] == code and "secret" not in control.error_code(error)[1]
