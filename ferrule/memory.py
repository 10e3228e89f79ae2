"""Collections of memories for agents, kept as datasets: vectors with a payload, searched by similarity."""

from __future__ import annotations

import json

from .engine import Engine

SCHEMA = "id string, values array<float>, metadata string"


class Memory:
    """One collection; scores are similarities, 1 / (1 + squared distance)."""

    def __init__(self, engine: Engine, name: str, dimension: int):
        self.engine, self.name, self.dimension = engine, name, dimension
        self.create_col()

    def create_col(self) -> None:
        if self.name not in self.list_cols():
            self.engine.create(self.name, self.dimension)

    def list_cols(self) -> list[str]:
        return [d["name"] for d in self.engine.datasets()]

    def col_info(self) -> dict:
        now = self.engine.describe(self.name)
        return {"name": self.name, "dimension": now["dimension"], "count": self.engine.count(self.name)}

    def delete_col(self) -> None:
        self.engine.drop(self.name)

    def reset(self) -> None:
        self.delete_col()
        self.create_col()

    def insert(self, vectors: list[list[float]], payloads: list[dict], ids: list[str]) -> None:
        rows = [(i, [float(x) for x in v], json.dumps(p or {})) for i, v, p in zip(ids, vectors, payloads, strict=True)]
        self.engine.upsert(self.name, self.engine.spark.createDataFrame(rows, SCHEMA))

    def update(self, identifier: str, vector: list[float] | None = None, payload: dict | None = None) -> None:
        """What is not given stays; a payload's keys replace the stored ones of the same name."""
        now = self.engine.get(self.name, identifier)
        if now is None:
            raise KeyError(identifier)
        self.insert([now["values"] if vector is None else vector], [now["metadata"] | (payload or {})], [identifier])

    def delete(self, identifier: str) -> None:
        self.engine.delete(self.name, self.engine.spark.createDataFrame([(identifier,)], "id string"))

    def get(self, identifier: str) -> dict | None:
        return self.engine.get(self.name, identifier)

    def search(self, vector: list[float], limit: int = 5, filters: dict | None = None) -> list[dict]:
        """Nearest first; filters without a value don't count."""
        wanted = {k: v for k, v in (filters or {}).items() if v is not None}
        hits = self.engine.query(self.name, vector, limit, wanted or None)
        return [{"id": h["id"], "score": 1 / (1 + h["score"]), "payload": h["metadata"]} for h in hits]

    def list(self, filters: dict | None = None, limit: int = 100) -> list[dict]:
        from pyspark.sql import functions as F

        from .functions.expressions import metadata_matches

        wanted = {k: v for k, v in (filters or {}).items() if v is not None}
        rows = self.engine.state(self.name).where(metadata_matches(F.col("metadata"), wanted)).orderBy("id").limit(limit).collect()
        return [{"id": r["id"], "payload": json.loads(r["metadata"])} for r in rows]

    def keyword_search(self, *_, **__) -> None:
        """There is no keyword index."""
