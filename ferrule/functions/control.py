"""Driver-side helpers of the request surface: cursors, names, times, flags, rate limits, routing, error codes."""

from __future__ import annotations

import base64
import binascii
import datetime
import hashlib
import json
import re
import time

# Form of a dataset's name, default and largest page, default and largest number of matches, rate limit.
NAME = re.compile(r"[a-z0-9_-]{1,64}")
PAGE, MOST_PAGE, MATCHES, MOST_MATCHES = 100, 1000, 10, 1000
RATE, BURST = 50.0, 100.0


def check_name(name: str) -> str:
    if not isinstance(name, str) or not NAME.fullmatch(name):
        raise ValueError("invalid_name")
    return name


def encode_cursor(last: str) -> str:
    return base64.urlsafe_b64encode(json.dumps({"a": last}, separators=(",", ":")).encode()).decode()


def decode_cursor(cursor: str | None) -> str | None:
    """The id after which the page begins."""
    if not cursor:
        return None
    try:
        last = json.loads(base64.urlsafe_b64decode(cursor))["a"]
    except (binascii.Error, ValueError, KeyError, TypeError) as error:
        raise ValueError("invalid_cursor") from error
    if not isinstance(last, str):
        raise ValueError("invalid_cursor")
    return last


def iso_time(seconds: float) -> str:
    """Seconds since 1970 as a time in UTC, to the second."""
    return datetime.datetime.fromtimestamp(seconds, datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def parse_iso(text: str | None) -> datetime.datetime | None:
    """A time with its zone (UTC where none is given); None for what isn't one."""
    try:
        found = datetime.datetime.fromisoformat(text)
    except (TypeError, ValueError):
        return None
    return found if found.tzinfo else found.replace(tzinfo=datetime.timezone.utc)


def is_on(flag: str | None, bare: bool = False) -> bool:
    """Whether a setting is switched on; with bare, also one that is there without a value."""
    return flag is not None and flag.strip().lower() in {"1", "true", "yes", "on", *([""] if bare else [])}


class StoreTimeout(TimeoutError):
    """A file of the store was waited for too long."""


class CacheFull(RuntimeError):
    """There is no room for what a query would keep."""


class RecentUnavailable(RuntimeError):
    """What was written last can't be read."""


# Codes of failed queries in the order in which they are tried; a subclass comes before its base.
FAILURES = (
    (RecentUnavailable, "recall_unavailable"), (PermissionError, "cache_unavailable"), (CacheFull, "cache_capacity_exceeded"),
    (StoreTimeout, "storage_unavailable"), (FileNotFoundError, "storage_unavailable"), (OSError, "cache_unavailable"),
)


def error_code(error: BaseException) -> tuple[str, str]:
    """Code and message of a failed query; the message names the kind of error and nothing that its text may give away."""
    code = next((code for kind, code in FAILURES if isinstance(error, kind)), "ephemeral_error")
    return code, f"Query failed: {type(error).__name__}"


class TokenBucket:
    """A rate limit that allows bursts: each call spends one token, tokens come back with time."""

    def __init__(self, rate: float = RATE, burst: float = BURST, clock=time.monotonic):
        self.rate, self.burst, self.clock = rate, burst, clock
        self.tokens, self.last = burst, clock()

    def take(self) -> bool:
        now = self.clock()
        self.tokens = min(self.burst, self.tokens + (now - self.last) * self.rate)
        self.last = now
        if self.tokens < 1:
            return False
        self.tokens -= 1
        return True


class DailyQuota:
    """A count that starts anew each day; a charge is made whole or not at all."""

    def __init__(self, limit: int, today=lambda: time.strftime("%Y-%m-%d", time.gmtime())):
        self.limit, self.today, self.day, self.used = limit, today, None, 0

    def charge(self, amount: int = 1) -> bool:
        day = self.today()
        if day != self.day:
            self.day, self.used = day, 0
        if self.used + amount > self.limit:
            return False
        self.used += amount
        return True


def ranked_hosts(key: str, urls: list[str]) -> list[str]:
    """Hosts by rendezvous hashing, the preferred one first."""
    return sorted(urls, key=lambda url: hashlib.sha256(f"{key}|{url}".encode()).hexdigest(), reverse=True)
