"""Semi-structured values: JSON paths, key=value maps, coded concepts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def json_value(json: Column | str, path: str, kind: str = "string") -> Column:
    """Typed value at a path of a JSON text; NULL for bad JSON, a missing path or a bad cast."""
    return F.try_variant_get(F.try_parse_json(_col(json)), path, kind)


def json_path(json: Column | str, dotted: str, default: str | None = None) -> Column:
    """Text at ``a.0.b`` style paths, digits index lists."""
    path = "$" + "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in dotted.split("."))
    value = F.get_json_object(_col(json), path)
    return F.coalesce(value, F.lit(default)) if default is not None else value


def reference_id(reference: Column | str) -> Column:
    """``Patient/123`` to ``123``."""
    return F.substring_index(_col(reference), "/", -1)


def first_coding(concept: Column) -> Column:
    """system, code and display of a concept: its first coding, else only its text as display."""
    coding = F.try_element_at(concept["coding"], F.lit(1))
    has = F.coalesce(F.size(concept["coding"]) > 0, F.lit(False))
    return F.struct(
        F.when(has, coding["system"]).alias("system"),
        F.when(has, coding["code"]).alias("code"),
        F.when(has, coding["display"]).otherwise(concept["text"]).alias("display"),
    )


def identifier_value(identifiers: Column, suffix: str, strict: bool = False) -> Column:
    """Value of the identifier whose system ends with ``suffix``.

    Falls back to the first identifier unless ``strict``.
    """
    match = F.try_element_at(
        F.filter(identifiers, lambda i: F.endswith(F.coalesce(i["system"], F.lit("")), F.lit(suffix))), F.lit(1)
    )
    found = match["value"]
    if strict:
        return found
    return F.when(match.isNotNull(), found).otherwise(F.try_element_at(identifiers, F.lit(1))["value"])


def key_values(text: Column | str, pair_sep: str = ";", kv_sep: str = "=") -> Column:
    """``A=1;B`` to a map; a key without value gets ``true``; a repeated key keeps its last value."""
    items = F.split(_col(text), pair_sep)
    last = F.transform(
        items,
        lambda item: F.struct(
            F.substring_index(item, kv_sep, 1).alias("key"),
            F.when(
                F.contains(item, F.lit(kv_sep)), F.call_function("substr", item, F.call_function("instr", item, F.lit(kv_sep)) + 1)
            )
            .otherwise("true")
            .alias("value"),
        ),
    )
    names = F.transform(last, lambda e: e["key"])
    kept = F.filter(
        last,
        lambda e, i: ~F.array_contains(F.slice(names, i + 2, F.greatest(F.size(names) - i - 1, F.lit(0))), e["key"]),
    )
    return F.map_from_entries(kept)


def key_values_text(pairs: Column | str, pair_sep: str = ";", kv_sep: str = "=") -> Column:
    """Map to text, entries without value dropped."""
    used = F.filter(F.map_entries(_col(pairs)), lambda e: e["value"].isNotNull() & (e["value"] != ""))
    return F.array_join(F.transform(used, lambda e: F.concat_ws(kv_sep, e["key"], e["value"])), pair_sep)
