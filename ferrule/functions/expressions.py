"""Scalar expressions of the engine, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def l2_squared(a: Column, b: Column) -> Column:
    """Squared Euclidean distance, summed in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v)


def similarity(score: Column) -> Column:
    """Distance to a similarity between 0 and 1."""
    return 1.0 / (1.0 + score)


def id_to_int64(identifier: Column) -> Column:
    """First eight bytes of the SHA-1 of an id, sign bit cleared."""
    digest = F.sha1(identifier)
    high = F.conv(F.substring(digest, 1, 1), 16, 10).cast("int").bitwiseAND(F.lit(7)).cast("string")
    return F.conv(F.concat(high, F.substring(digest, 2, 15)), 16, 10).cast("bigint")


def vector_literal(values: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(values.cast("array<string>"), ","), F.lit("]"))


def parse_vector(literal: Column) -> Column:
    return F.from_json(literal, "array<float>")


def merged(base: Column, patch: Column) -> Column:
    """Shallow merge of two maps; the patch's value wins where both have a key, and null counts as no entries."""
    empty = F.create_map().cast("map<string,string>")
    base, patch = F.coalesce(base, empty), F.coalesce(patch, empty)
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys(patch), k)), patch)


def _family(value: object) -> str:
    if isinstance(value, bool):
        return "BOOLEAN"
    if isinstance(value, int):
        return "BIGINT"
    return "DOUBLE" if isinstance(value, float) else "STRING"


def metadata_matches(metadata: Column, wanted: dict) -> Column:
    """AND of equalities on a JSON document; a value equals only values of its own type, null equals nothing."""
    document, out = F.try_parse_json(metadata), F.lit(True)
    for key, value in wanted.items():
        if value is None:
            return F.lit(False)
        path = "$[\"" + key.replace("\\", "\\\\").replace('"', '\\"') + "\"]"
        found = F.try_variant_get(document, path, "variant")
        kind = F.schema_of_variant(found)
        family = F.when(kind.startswith("DECIMAL") | (kind == "DOUBLE") | (kind == "FLOAT"), "DOUBLE").otherwise(kind)
        want = _family(value)
        same = F.try_variant_get(document, path, want.lower()) == F.lit(value)
        out = out & F.coalesce((family == want) & same, F.lit(False))
    return out
