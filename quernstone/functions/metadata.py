"""Filters on nested metadata: JSON as variants, paths such as `metadata.size.chars` or `metadata.tags[0]`, comparison by type.

A value is compared with values of its own kind: a number with numbers, a text with texts, a boolean with booleans. What is of another
kind or missing is unknown, as a null is, so neither a condition nor its negation holds. JSON's null counts as missing.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

STEP = re.compile(r"\.?([A-Za-z_][A-Za-z0-9_-]*)|\[(\d+)\]")
NUMBER = r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)$"


def variant(json: Column) -> Column:
    """Metadata as it comes; what is no JSON is null."""
    return F.try_parse_json(json)


def variant_path(path: str) -> str:
    """`size.chars` or `tags[0].name` as a variant's path."""
    at, out = 0, "$"
    while at < len(path):
        step = STEP.match(path, at)
        if not step or step.end() == at:
            raise ValueError(f"bad metadata path {path!r}")
        out += f"['{step.group(1)}']" if step.group(1) else f"[{step.group(2)}]"
        at = step.end()
    return out


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def typed(value: Column, like) -> Column:
    """A variant as the type of a given Python value; null where it is of another kind."""
    kind = _kind(value)
    if isinstance(like, bool):
        return F.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))
    if isinstance(like, int):
        # whole numbers in full, others as doubles
        return F.when(kind.isin("TINYINT", "SMALLINT", "INT", "BIGINT"), F.try_variant_get(value, "$", "decimal(38,9)")).when(kind.rlike(NUMBER), F.try_variant_get(value, "$", "double").cast("decimal(38,9)"))
    if isinstance(like, float):
        return F.when(kind.rlike(NUMBER), F.try_variant_get(value, "$", "double"))
    if isinstance(like, str):
        return F.when(kind == "STRING", F.try_variant_get(value, "$", "string"))
    raise ValueError(f"no comparison with {like!r}")


def condition(column: Column, path: str, op: str, value) -> Column:
    """A comparison of what lies at a path of a variant column."""
    at = F.try_variant_get(column, variant_path(path), "variant")
    at = F.when(_kind(at) != "VOID", at)
    if op == "exists":
        return at.isNotNull() if value is not False else at.isNull()
    if op == "in":
        values = list(value)
        if not values:
            return F.lit(False)
        held = [typed(at, v) == F.lit(v) for v in values]
        known = F.coalesce(*[F.when(h, F.lit(True)) for h in held])
        some = F.coalesce(*held)
        return F.coalesce(known, some)
    if op == "contains":
        items = F.try_variant_get(at, "$", "array<variant>")
        inside = F.exists(items, lambda i: F.coalesce(typed(i, value) == F.lit(value), F.lit(False)))
        is_list = _kind(at).startswith("ARRAY")
        text = F.when(_kind(at) == "STRING", F.try_variant_get(at, "$", "string").contains(value)) if isinstance(value, str) else F.lit(None).cast("boolean")
        return F.when(is_list, inside).otherwise(text)
    have, want = typed(at, value), F.lit(value)
    made = {"=": have == want, "<>": have != want, "<": have < want, "<=": have <= want, ">": have > want, ">=": have >= want}
    if op not in made:
        raise ValueError(f"unknown operation {op!r}")
    return made[op]
