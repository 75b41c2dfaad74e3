"""Coerce JSON payloads to the known keys and field types, with the violations found."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keys that a payload may have, and the fields of an atomic fact with their type.
TOP_KEYS = ("query", "facts", "atomic_facts", "self_corrected", "nli_verified_fields")
FACT_FIELDS = {"subject": "string", "predicate": "string", "object_value": "string", "fact_type": "string", "is_negative": "boolean", "source_text": "string"}


def unknown_keys(json: Column, allowed: tuple[str, ...] = TOP_KEYS) -> Column:
    """Top-level keys outside the allowed ones; null for text that is no JSON object."""
    return F.array_except(F.json_object_keys(json), F.array(*map(F.lit, allowed)))


def coerce_fact(json: Column) -> Column:
    """Struct of FACT_FIELDS and violations: missing and null fields get defaults, wrong types defaults and a violation."""
    value = F.try_parse_json(json)
    fields, bad = [], []
    for name, kind in FACT_FIELDS.items():
        raw = F.try_variant_get(value, f"$.{name}", "variant")
        shape = F.schema_of_variant(raw)
        wanted = {"string": "STRING", "boolean": "BOOLEAN"}[kind]
        default = F.lit("") if kind == "string" else F.lit(False)
        right = shape == wanted
        fields.append(F.when(right, F.try_variant_get(value, f"$.{name}", kind)).otherwise(default).alias(name))
        bad.append(F.when(raw.isNotNull() & ~right & (shape != "VOID"), F.lit(name)))
    return F.struct(*fields, F.array_compact(F.array(*bad)).alias("violations"))


def coerce_payload(json: Column) -> Column:
    """Struct (atomic_facts, facts, violations) of a payload, whatever its shape.

    What is no object, unknown keys, a list that is none and items that are no objects are left out, each with a violation;
    fields of the wrong type get their default with one. ``facts`` are handed through.
    """
    value = F.try_parse_json(json)
    is_object = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    whole = F.when(is_object, json)
    strange = F.coalesce(unknown_keys(whole), F.array().cast("array<string>"))
    listed = F.get_json_object(whole, "$.atomic_facts")
    is_list = F.coalesce(F.schema_of_variant(F.try_variant_get(value, "$.atomic_facts", "variant")).startswith("ARRAY"), F.lit(False))
    items = F.coalesce(F.from_json(F.when(is_list, listed), "array<string>"), F.array().cast("array<string>"))
    # an item that is a string may look like an object: the text of the list tells them apart by what it starts with
    shaped = F.transform(items, lambda x: F.when(F.coalesce(F.json_object_keys(x).isNotNull(), F.lit(False)), coerce_fact(x)))
    kept = F.filter(shaped, lambda x: x.isNotNull())
    facts = F.transform(kept, lambda x: F.struct(*[x[f].alias(f) for f in FACT_FIELDS]))
    given = F.coalesce(F.from_json(F.get_json_object(whole, "$.facts"), "array<struct<key:string,value:string,source_text:string,is_numeric:boolean>>"), F.array().cast("array<struct<key:string,value:string,source_text:string,is_numeric:boolean>>"))
    at = lambda i, text: F.concat(F.lit("atomic_facts["), i.cast("string"), F.lit("]"), F.lit(text))
    of_items = F.flatten(F.transform(shaped, lambda x, i: F.when(x.isNull(), F.array(at(i, " 必须是 object，已剔除"))).otherwise(F.transform(x["violations"], lambda f: F.concat(at(i, "."), f, F.lit(" 类型非法，已规范化为默认值"))))))
    found = F.concat(
        F.when(is_object, F.array().cast("array<string>")).otherwise(F.array(F.lit("顶层必须是 JSON object"))),
        F.transform(strange, lambda k: F.concat(F.lit("未知顶层键 '"), k, F.lit("'，已剔除"))),
        F.when(listed.isNotNull() & ~is_list, F.array(F.lit("atomic_facts 必须是数组"))).otherwise(F.array().cast("array<string>")),
        of_items,
    )
    return F.struct(facts.alias("atomic_facts"), given.alias("facts"), found.alias("violations"))


def typed_field(json: Column, name: str, kind: str) -> Column:
    """Struct (value, violation) of one field of a JSON object."""
    raw = F.get_json_object(json, f"$.{name}")
    value = raw.try_cast(kind)
    return F.struct(value.alias("value"), (raw.isNotNull() & value.isNull()).alias("violation"))
