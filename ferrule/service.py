"""The requests around the engine: validated queries, queued work, results, import jobs, accounts.

Everything here is driver-side and small; its state lies in the store beside the
datasets, as records that change by compare-and-set, so several drivers can
share it.  The data's work is the engine's.
"""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import secrets
import time
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .functions.control import MATCHES, MOST_MATCHES, error_code, iso_time
from .sources.manifest import Files
from .sources.records import Records

# Deliveries before a message is set aside, seconds until one counts as lost and a dataset as stuck, seconds that results, tokens and uploads hold, most probed cells, quotas.
ATTEMPTS, LOST, STUCK = 5, 300, 900
RESULT_TTL, TOKEN_TTL, UPLOAD_TTL = 3600, 24 * 3600, 3600
MOST_PROBED, VECTORS, QUERIES_A_DAY = 1024, 100_000, 10_000
MOST_UPLOAD = 5 << 30
# States of an import job with the share that is done, its formats and modes.
DONE = {"awaiting_upload": 0, "validating": 25, "indexing": 90, "completed": 100, "failed": 100}
FORMATS, MODES = ("ndjson", "parquet"), ("continue", "abort")


class Refused(ValueError):
    """A request that can't be met; its text is the error's code."""


class Queue:
    """Messages by topic, in the order in which they came; each is delivered until it is acknowledged, ATTEMPTS times at most."""

    def __init__(self, files: Files, clock=time.time):
        self.files, self.clock = files, clock

    def _topic(self, topic: str) -> Records:
        return Records(self.files, f"queue-{topic}")

    def publish(self, topic: str, body: dict) -> str:
        key = f"{int(self.clock() * 1e6):020d}-{uuid.uuid4().hex}"
        self._topic(topic).add(key, {"body": body, "taken": None, "attempts": 0, "dead": False})
        return key

    def consume(self, topic: str) -> dict | None:
        """The first message that nobody has; its body, key, attempt and a receipt."""
        records = self._topic(topic)
        for found in records.all():
            if found["taken"] is not None or found["dead"]:
                continue
            receipt = uuid.uuid4().hex
            got = records.change(found["key"], lambda m: m | {"taken": self.clock(), "receipt": receipt, "attempts": m["attempts"] + 1} if m["taken"] is None and not m["dead"] else None)
            if got and got.get("receipt") == receipt:
                return {"topic": topic, "key": got["key"], "body": got["body"], "attempt": got["attempts"], "receipt": receipt}
        return None

    def ack(self, message: dict) -> None:
        self._topic(message["topic"]).remove(message["key"])

    def nack(self, message: dict, requeue: bool = True) -> bool:
        """Give a message back; True if it is set aside for good. A message that was taken from its holder meanwhile is left alone."""

        def change(m):
            if m.get("receipt") != message["receipt"] or m["taken"] is None:
                return None
            return m | {"taken": None, "dead": not requeue or m["attempts"] >= ATTEMPTS}

        now = self._topic(message["topic"]).change(message["key"], change)
        return bool(now and now["dead"])

    def dead(self, topic: str) -> list[dict]:
        return [m for m in self._topic(topic).all() if m["dead"]]

    def reclaim(self, topic: str, seconds: float = LOST) -> int:
        """Give back the messages whose holder has not answered for so long."""
        count = 0
        for m in self._topic(topic).all():
            if m["taken"] is not None and self.clock() - m["taken"] >= seconds:
                self.nack({"topic": topic, "key": m["key"], "receipt": m["receipt"]})
                count += 1
        return count


class Results:
    """Answers of queued queries, for RESULT_TTL seconds."""

    def __init__(self, files: Files, clock=time.time):
        self.records, self.clock = Records(files, "results"), clock

    def put(self, key: str, result: dict) -> None:
        self.records.change(key, lambda _: {"key": key, "result": result, "until": self.clock() + RESULT_TTL}, create=True)

    def get(self, key: str) -> dict | None:
        found = self.records.get(key)
        return found["result"] if found and self.clock() < found["until"] else None

    def sweep(self) -> int:
        old = [r["key"] for r in self.records.all() if self.clock() >= r["until"]]
        for key in old:
            self.records.remove(key)
        return len(old)


class Accounts:
    """Tenants with a password, tokens, keys and quotas; of secrets only digests are kept."""

    def __init__(self, files: Files, secret: bytes, clock=time.time, prefix: str = "fr_live_"):
        self.tenants, self.emails, self.keys = Records(files, "tenants"), Records(files, "emails"), Records(files, "keys")
        self.secret, self.clock, self.prefix = secret, clock, prefix

    @staticmethod
    def _sealed(password: str, salt: bytes) -> str:
        return hashlib.scrypt(password.encode(), salt=salt, n=1 << 14, r=8, p=1).hex()

    @staticmethod
    def _named(email: str) -> str:
        return hashlib.sha256(email.strip().lower().encode()).hexdigest()

    def signup(self, email: str, password: str) -> dict:
        if "@" not in email or len(password) < 8:
            raise Refused("invalid_request")
        tenant, salt = uuid.uuid4().hex, secrets.token_bytes(16)
        if not self.emails.add(self._named(email), {"tenant": tenant}):
            raise Refused("email_taken")
        self.tenants.add(tenant, {"email": email.strip(), "plan": "free", "created": self.clock(), "salt": salt.hex(), "password": self._sealed(password, salt), "vectors": 0, "day": None, "queries": 0})
        return self.tenant(tenant) | {"token": self.token(tenant)}

    def login(self, email: str, password: str) -> str:
        named = self.emails.get(self._named(email))
        row = named and self.tenants.get(named["tenant"])
        # as much work for an unknown address as for a known one
        sealed = self._sealed(password, bytes.fromhex(row["salt"]) if row else b"\0" * 16)
        if not row or not hmac.compare_digest(sealed, row["password"]):
            raise Refused("unauthorized")
        return self.token(row["key"])

    def tenant(self, tenant: str) -> dict:
        row = self.tenants.get(tenant)
        if row is None:
            raise Refused("unauthorized")
        return {"id": tenant, "email": row["email"], "plan": row["plan"], "created_at": iso_time(row["created"])}

    def _signed(self, text: str) -> str:
        return _b64(hmac.new(self.secret, text.encode(), hashlib.sha256).digest())

    def token(self, tenant: str) -> str:
        """A signed token (HS256) that holds for TOKEN_TTL seconds."""
        now = int(self.clock())
        text = ".".join(_b64(json.dumps(x, separators=(",", ":")).encode()) for x in ({"alg": "HS256", "typ": "JWT"}, {"sub": tenant, "iat": now, "exp": now + TOKEN_TTL}))
        return f"{text}.{self._signed(text)}"

    def owner(self, bearer: str) -> str | None:
        """The tenant of a token or key; None for all others, without telling why."""
        if bearer.startswith(self.prefix):
            row = self.keys.get(hashlib.sha256(bearer.encode()).hexdigest())
            if row is None or row["revoked"] is not None:
                return None
            self.keys.change(row["key"], lambda k: k | {"used": self.clock()})
            return row["tenant"]
        text, _, mark = bearer.rpartition(".")
        try:
            head, body = (json.loads(_unb64(x)) for x in text.split("."))
            good = head["alg"] == "HS256" and hmac.compare_digest(mark, self._signed(text)) and self.clock() < body["exp"]
            return body["sub"] if good and isinstance(body["sub"], str) else None
        except (ValueError, KeyError, TypeError):
            return None

    def create_key(self, tenant: str, name: str) -> dict:
        """The one time that the key itself is shown."""
        raw = self.prefix + secrets.token_urlsafe(24)
        self.keys.add(hashlib.sha256(raw.encode()).hexdigest(), {"id": f"key_{uuid.uuid4().hex}", "tenant": tenant, "name": name, "created": self.clock(), "used": None, "revoked": None})
        return self._key(self.keys.get(hashlib.sha256(raw.encode()).hexdigest())) | {"key": raw}

    @staticmethod
    def _key(row: dict) -> dict:
        told = lambda x: None if x is None else iso_time(x)
        return {"id": row["id"], "name": row["name"], "created_at": told(row["created"]), "last_used_at": told(row["used"]), "revoked_at": told(row["revoked"])}

    def list_keys(self, tenant: str) -> list[dict]:
        return [self._key(r) for r in sorted(self.keys.all(), key=lambda r: r["created"]) if r["tenant"] == tenant]

    def revoke_key(self, tenant: str, identifier: str) -> None:
        for row in self.keys.all():
            if row["tenant"] == tenant and row["id"] == identifier:
                self.keys.change(row["key"], lambda k: k | {"revoked": k["revoked"] or self.clock()})
                return
        raise Refused("key_not_found")

    def charge_query(self, tenant: str, limit: int = QUERIES_A_DAY) -> bool:
        """One query of today's; the count starts anew each day."""
        return self._charge(tenant, lambda r: r | {"queries": r["queries"] + 1} if r["queries"] < limit else None)

    def charge_vectors(self, tenant: str, amount: int, limit: int = VECTORS) -> bool:
        """All of them or none."""
        return self._charge(tenant, lambda r: r | {"vectors": r["vectors"] + amount} if r["vectors"] + amount <= limit else None)

    def _charge(self, tenant: str, spend) -> bool:
        done: list[bool] = []

        def change(row):
            done.clear()
            new = spend(self._today(row))
            done.append(new is not None)
            return new

        return self.tenants.change(tenant, change) is not None and done == [True]

    def _today(self, row: dict) -> dict:
        day = iso_time(self.clock())[:10]
        return row if row["day"] == day else row | {"day": day, "queries": 0}

    def usage(self, tenant: str) -> dict:
        row = self.tenants.get(tenant)
        if row is None:
            raise Refused("unauthorized")
        return {"enabled": True, "vectors_used": row["vectors"], "vector_quota": VECTORS, "queries_today": self._today(row)["queries"], "query_quota": QUERIES_A_DAY}


def _b64(data: bytes) -> str:
    return base64.urlsafe_b64encode(data).rstrip(b"=").decode()


def _unb64(text: str) -> bytes:
    return base64.urlsafe_b64decode(text + "=" * (-len(text) % 4))


class Service:
    """What one tenant can ask for."""

    def __init__(self, spark: SparkSession, root: str, tenant: str = "default", clock=time.time, sign=None):
        """sign(method, path, seconds) makes a link of the store's own kind; without it the path itself is the link."""
        self.engine, self.clock = Engine(spark, root, tenant, clock), clock
        self.sign = sign or (lambda method, path, seconds: path)
        files = self.engine.files
        self.queue, self.results, self.jobs = Queue(files, clock), Results(files, clock), Records(files, "imports")

    # ---- queries

    def checked_query(self, body) -> dict:
        """Arguments of Engine.query, or the first reason why the body can't be asked."""
        if not isinstance(body, dict):
            raise Refused("invalid_request")
        name, vector = body.get("dataset"), body.get("vector")
        try:
            now = self.engine.describe(name)
        except (KeyError, ValueError):
            raise Refused("dataset_not_found") from None
        number = lambda x, *kinds: isinstance(x, kinds) and not isinstance(x, bool)
        if not isinstance(vector, list) or not all(number(x, int, float) for x in vector):
            raise Refused("invalid_request")
        if len(vector) != now["dimension"]:
            raise Refused("dimension_mismatch")
        k, probed, wanted = (body.get(x) for x in ("top_k", "nprobe", "filter"))
        k = MATCHES if k is None else k
        if not number(k, int) or not 1 <= k <= MOST_MATCHES:
            raise Refused("top_k_out_of_range")
        if probed is not None and (not number(probed, int) or probed < 1):
            raise Refused("invalid_request")
        if probed is not None and probed > MOST_PROBED:
            raise Refused("nprobe_out_of_range")
        if wanted is not None and (not isinstance(wanted, dict) or any(isinstance(v, (dict, list)) for v in wanted.values())):
            raise Refused("invalid_request")
        return {"name": name, "vector": [float(x) for x in vector], "k": k, "wanted": wanted or None, "probed": probed}

    def query(self, body) -> dict:
        asked, began = self.checked_query(body), self.clock()
        return {"matches": self.engine.query(**asked), "latency_ms": int(1000 * (self.clock() - began))}

    def submit(self, body) -> str:
        """Queue a query; its key tells its status later."""
        asked = self.checked_query(body)
        return self.queue.publish("query", asked)

    def status(self, key: str) -> dict:
        """ready is False for a query that isn't answered and for one that is unknown."""
        found = self.results.get(key)
        if found is None:
            return {"ready": False}
        if "error" in found:
            raise Refused(found["error"]["code"])
        return {"ready": True} | found

    # ---- import jobs

    def create_import(self, dataset: str, form: str, mode: str = "continue", most_bad: int | None = None) -> dict:
        try:
            self.engine.describe(dataset)
        except (KeyError, ValueError):
            raise Refused("dataset_not_found") from None
        if form not in FORMATS:
            raise Refused("invalid_format")
        if mode not in MODES:
            raise Refused("invalid_error_mode")
        if most_bad is not None and (isinstance(most_bad, bool) or not isinstance(most_bad, int) or most_bad < 0):
            raise Refused("invalid_max_bad_records")
        key = f"imp_{uuid.uuid4().hex}"
        upload = f"{self.engine.root}/.staging/{key}/upload.{form}"
        self.jobs.add(key, {"dataset": dataset, "format": form, "mode": mode, "most_bad": most_bad, "status": "awaiting_upload", "upload": upload, "created": self.clock(), "completed": None, "counts": [0, 0, 0], "rejected": None, "error": None})
        target = {"method": "PUT", "url": self.sign("PUT", upload, UPLOAD_TTL), "content_type": "application/octet-stream", "max_bytes": MOST_UPLOAD, "expires_at": iso_time(self.clock() + UPLOAD_TTL)}
        return self.import_job(dataset, key) | {"upload": target}

    def _job(self, dataset: str, key: str) -> dict:
        found = self.jobs.get(key)
        if found is None or found["dataset"] != dataset:
            raise Refused("import_not_found")
        return found

    def import_job(self, dataset: str, key: str) -> dict:
        job = self._job(dataset, key)
        processed, accepted, rejected = job["counts"]
        return {
            "import_id": key, "dataset": dataset, "format": job["format"], "status": job["status"], "error_mode": job["mode"], "max_bad_records": job["most_bad"],
            "records_processed": processed, "records_accepted": accepted, "records_rejected": rejected, "percent_complete": DONE[job["status"]],
            "rejected_records_url": self.sign("GET", job["rejected"], UPLOAD_TTL) if rejected and job["rejected"] else None, "error_message": job["error"] if job["status"] == "failed" else None,
            "created_at": iso_time(job["created"]), "completed_at": None if job["completed"] is None else iso_time(job["completed"]),
        }

    def imports(self, dataset: str) -> list[dict]:
        """A dataset's jobs, the newest first."""
        found = [j for j in self.jobs.all() if j["dataset"] == dataset]
        return [self.import_job(dataset, j["key"]) for j in sorted(found, key=lambda j: (j["created"], j["key"]), reverse=True)]

    def complete_import(self, dataset: str, key: str) -> dict:
        """The upload is there: queue the job."""
        job = self._job(dataset, key)
        if job["status"] != "awaiting_upload":
            raise Refused("invalid_state")
        if not self.engine.files.exists(job["upload"]):
            raise Refused("upload_missing")
        self.jobs.change(key, lambda j: j | {"status": "validating"})
        self.queue.publish("import", {"dataset": dataset, "key": key})
        return self.import_job(dataset, key)

    def _run_import(self, dataset: str, key: str) -> None:
        job = self._job(dataset, key)
        if job["status"] not in ("validating", "indexing"):
            return
        put = lambda **new: self.jobs.change(key, lambda j: j | new)
        if self.engine.files.size(job["upload"]) > MOST_UPLOAD:
            put(status="failed", error="the upload is too large", completed=self.clock())
            return
        try:
            kind = "parquet" if job["format"] == "parquet" else "jsonl"
            got = self.engine.import_file(dataset, job["upload"], kind, job["mode"] == "abort", job["most_bad"])
        except ValueError as error:
            put(status="failed", error=str(error), completed=self.clock())
            return
        put(status="indexing", counts=[got["processed"], got["accepted"], got["rejected"]], rejected=f"{self.engine.root}/{dataset}/rejected/{got['job']}" if got["rejected"] else None)
        if got["failed"]:
            put(status="failed", error=f"{got['rejected']} bad records, the first in line {got['first_bad']}", completed=self.clock())
            return
        self.engine.consolidate(dataset)
        put(status="completed", completed=self.clock())

    # ---- work that waits

    def work(self, most: int = 100) -> int:
        """Do what is queued, a message of each topic in turn; returns how many were handled."""
        handlers = {"import": lambda b, _: self._run_import(**b), "consolidate": lambda b, _: self.engine.consolidate(b["dataset"]), "query": self._answer}
        done = 0
        while done < most:
            taken = [m for topic in handlers if (m := self.queue.consume(topic)) is not None]
            if not taken:
                break
            for message in taken:
                try:
                    handlers[message["topic"]](message["body"], message["key"])
                    self.queue.ack(message)
                except KeyError:
                    self.queue.ack(message)  # its dataset is gone
                except Exception:
                    self.queue.nack(message)
                done += 1
        return done

    def _answer(self, asked: dict, key: str) -> None:
        began = self.clock()
        try:
            found = {"matches": self.engine.query(**asked), "latency_ms": int(1000 * (self.clock() - began)), "mode": "queued"}
        except Exception as error:
            code, message = error_code(error)
            found = {"error": {"code": code, "message": message}}
        self.results.put(key, found)

    def tick(self) -> dict:
        """What is to be done from time to time: fold logs that are due, give back lost messages, fail stuck datasets, drop old results and uploads."""
        names = [d["name"] for d in self.engine.datasets()]
        due = [n for n in names if self.engine.due(n)]
        for name in due:
            self.queue.publish("consolidate", {"dataset": name})
        reclaimed = sum(self.queue.reclaim(topic) for topic in ("import", "consolidate", "query"))
        stuck = sum(self.engine.fail_if_stale(n, STUCK, f"waited for its index for over {STUCK} s") for n in names if n not in due)
        return {"due": len(due), "messages_reclaimed": reclaimed, "datasets_failed": stuck, "results": self.results.sweep(), "uploads": self._sweep_uploads(), "landed": sum(self.engine.sweep_landed(n) for n in names)}

    def _sweep_uploads(self) -> int:
        """Uploads of jobs that have ended; what was rejected stays."""
        files, gone = self.engine.files, 0
        for job in self.jobs.all():
            if DONE[job["status"]] == 100 and files.exists(job["upload"]):
                files.delete(job["upload"])
                gone += 1
        return gone

    def by_native_id(self, dataset: str):
        """id64, id of the live records, for callers that hold hits by number."""
        from .functions.expressions import id_to_int64

        return self.engine.state(dataset).select(id_to_int64(F.col("id")).alias("id64"), "id")
