"""Names of shard files: with a digest of their content, or dated as they once were."""

from __future__ import annotations

import hashlib
import re
import time

# Form of a shard's name with a digest of its content; buckets, tenants and datasets are single parts.
FORM = re.compile(r"s3://([^/]+)/([^/]+)/([^/]+)/([^/]+)-([0-9a-f]{16})[.]bin")


def content_digest(content: bytes) -> str:
    return hashlib.sha256(content).hexdigest()[:16]


def shard_uri(bucket: str, tenant: str, dataset: str, shard: str, content: bytes) -> str:
    return f"s3://{bucket}/{tenant}/{dataset}/{shard}-{content_digest(content)}.bin"


def dated_uri(prefix: str, tenant: str, dataset: str, name: str, seconds: float | None = None) -> str:
    return f"{prefix}/{tenant}/{dataset}/indexes/{time.strftime('%Y-%m-%d', time.gmtime(seconds))}/{name}"


def parse(uri: str) -> dict:
    """bucket, tenant, dataset, shard, digest; the shard's name may have hyphens, the last one ends it."""
    found = FORM.fullmatch(uri) if isinstance(uri, str) else None
    if not found:
        raise ValueError("invalid_shard_uri")
    return dict(zip(("bucket", "tenant", "dataset", "shard", "digest"), found.groups(), strict=True))


def is_legacy(uri: str) -> bool:
    """Whether it names a shard without a digest of its content."""
    if not isinstance(uri, str) or not re.fullmatch(r"s3://.*", uri, re.S):
        return False
    name = uri.rsplit("/", 1)[-1]
    return name.startswith("shard-") and name.endswith(".bin") and not FORM.fullmatch(uri)
