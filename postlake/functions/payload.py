"""Reading of semi-structured payloads (VARIANT): typed access that yields null where a level has another shape.

Each function takes the name of a variant column and a path, and gives one parsed expression: a flat row has over forty
of them, and building each from single column calls would take longer than running it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(s: str | None) -> str:
    """A SQL literal."""
    return "CAST(NULL AS STRING)" if s is None else "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def get(v: str, path: str, kind: str = "variant") -> str:
    return f"try_variant_get({v}, {quoted(path)}, '{kind}')"


def shape(v: str, path: str) -> str:
    return f"schema_of_variant({get(v, path)})"


def is_object(v: str, path: str = "$") -> Column:
    return F.expr(f"coalesce(startswith({shape(v, path)}, 'OBJECT'), false)")


def has_block(v: str, path: str) -> Column:
    """An object with something in it."""
    return F.expr(f"coalesce(startswith({shape(v, path)}, 'OBJECT') AND to_json({get(v, path)}) <> '{{}}', false)")


def text_sql(v: str, path: str) -> str:
    s, k = get(v, path, "string"), shape(v, path)
    return f"CASE WHEN {k} RLIKE '^(OBJECT|ARRAY)' THEN NULL WHEN {k} = 'BOOLEAN' THEN initcap({s}) ELSE {s} END"


def text(v: str, *paths: str) -> Column:
    """Strings and numbers as text, booleans as True or False; lists and objects are null. Of several paths, the first not null."""
    return F.expr(f"coalesce({', '.join(text_sql(v, p) for p in paths)})" if len(paths) > 1 else text_sql(v, paths[0]))


def whole(v: str, path: str) -> Column:
    """Numbers and numeric strings, truncated toward zero; all else is null."""
    return F.expr(f"CASE WHEN NOT {shape(v, path)} RLIKE '^(OBJECT|ARRAY|BOOLEAN)' THEN try_cast(try_cast(regexp_replace({get(v, path, 'string')}, '^\\\\s+|\\\\s+$', '') AS DOUBLE) AS BIGINT) END")


def long(v: str, path: str) -> Column:
    return F.expr(get(v, path, "long"))


def string(v: str, path: str) -> Column:
    return F.expr(get(v, path, "string"))


def flag(v: str, path: str) -> Column:
    return F.expr(f"CASE WHEN {shape(v, path)} = 'BOOLEAN' THEN {get(v, path, 'boolean')} END")


def number(v: str, path: str) -> Column:
    return F.expr(f"CASE WHEN {shape(v, path)} RLIKE '^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*)$' THEN {get(v, path, 'double')} END")


def nested(v: str, path: str) -> Column:
    """A list or object as a variant; empty ones, and booleans, are null."""
    x = get(v, path)
    return F.expr(f"CASE WHEN NOT coalesce(to_json({x}) IN ('[]', '{{}}') OR {shape(v, path)} = 'BOOLEAN', false) THEN {x} END")


def _items(v: str) -> str:
    """A list's items, an object's values, or a scalar alone."""
    return f"""CASE WHEN schema_of_variant({v}) LIKE 'ARRAY%' THEN try_cast({v} AS ARRAY<VARIANT>) WHEN schema_of_variant({v}) LIKE 'OBJECT%' THEN map_values(try_cast({v} AS MAP<STRING, VARIANT>))
        WHEN schema_of_variant({v}) <> 'VOID' THEN array({v}) ELSE CAST(array() AS ARRAY<VARIANT>) END"""


def values(v: str) -> Column:
    """A list's items, an object's values, or a scalar alone, each as its label (localizedName, name or label of an object)."""
    label = ", ".join(get("x", f"$.{k}", "string") for k in ("localizedName", "name", "label"))
    return F.expr(f"transform({_items(v)}, x -> coalesce({label}, CASE WHEN schema_of_variant(x) = 'STRING' THEN try_variant_get(x, '$', 'string') END))")


def odd_values(v: str) -> Column:
    """Of the items that values() looks at, those it can't read as text (numbers, booleans, lists, objects without a label), as JSON."""
    label = ", ".join(get("x", f"$.{k}", "string") for k in ("localizedName", "name", "label"))
    return F.expr(
        f"""transform(filter({_items(v)}, x -> schema_of_variant(x) NOT IN ('VOID', 'STRING') AND coalesce({label}) IS NULL), x -> to_json(x))"""
    )


def iso_date(c: Column) -> Column:
    return F.try_to_timestamp(F.substring(c, 1, 10), F.lit("yyyy-MM-dd")).cast("date")
