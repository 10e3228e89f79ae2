"""Small records of the control plane: each is a chain of numbered versions, so that a change is a compare-and-set."""

from __future__ import annotations

import uuid

from .manifest import Files, Manifests


class Records:
    """Records of one kind under one folder of a store."""

    def __init__(self, files: Files, kind: str):
        self.files, self.kind = files, f".{kind}"

    def _chain(self, key: str) -> Manifests:
        return Manifests(self.files, f"{self.kind}/{key}")

    def get(self, key: str) -> dict | None:
        found = self._chain(key).latest()
        return None if found is None or found.get("gone") else found

    def all(self) -> list[dict]:
        """Every record, in the order of the keys."""
        return [r for key in self.files.names(self.kind) if (r := self.get(key)) is not None]

    def add(self, key: str, record: dict) -> bool:
        """False where there is one of that key."""
        mark = uuid.uuid4().hex
        return self.change(key, lambda now: record | {"key": key, "mark": mark} if now is None else None, create=True).get("mark") == mark

    def change(self, key: str, change, create: bool = False) -> dict | None:
        """Apply change(record), which gives the new one or None to leave it; returns what is there then."""

        def step(now):
            now = None if now is None or now.get("gone") else now
            return change(now) if create or now is not None else None

        return self._chain(key).commit(step)

    def remove(self, key: str) -> None:
        self.files.delete(f"{self.files.root}/{self.kind}/{key}")
