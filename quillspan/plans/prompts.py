"""Prompts, answer schemas and worked examples, from sections and enumerations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def extraction_prompt(sections: Sequence[str], abstract: Column, suffix: str = "") -> Column:
    """Sections, abstract and suffix joined by blank lines; blank sections are left out."""
    parts = [F.lit(s) for s in sections if s.strip()] + [abstract] + ([F.lit(suffix)] if suffix else [])
    return F.concat_ws("\n\n", *parts)


def vocabulary_section(enumeration: DataFrame, fields: Sequence[str], heading: str) -> str:
    """The preferred terms of some fields as a prompt section; the enumeration is a vocabulary, shown whole."""
    rows = enumeration.where(F.col("field").isin(*fields)).groupBy("field").agg(F.array_sort(F.collect_list("value")).alias("v")).collect()
    held = {r["field"]: r["v"] for r in rows}
    blocks = ["\n".join([f"  {f}:", *(f'    - "{t}"' for t in held[f])]) for f in fields if held.get(f)]
    return "\n\n".join([heading, *blocks])


def answer_schema(strict: Mapping[str, Sequence[str]], preferred: Mapping[str, Sequence[str]], free: Sequence[str]) -> dict:
    """JSON schema of an answer: fields with fixed values, with preferred values or free text.

    Preferred fields without values are left out; all others are required.
    """
    items: dict[str, dict] = {f: {"enum": list(v)} for f, v in strict.items()}
    items |= {f: {"anyOf": [{"enum": list(v)}, {"type": "string"}]} for f, v in preferred.items() if v}
    items |= {f: {"type": "string"} for f in free if f not in items}
    fields = {
        f: {
            "type": "object",
            "properties": {"values": {"type": "array", "items": i}, "reasoning": {"type": "string"}},
            "required": ["values", "reasoning"],
        }
        for f, i in items.items()
    }
    return {"type": "object", "properties": fields, "required": list(fields)}


def allowed_values(items: Mapping) -> tuple[list[str], bool]:
    """Values that a field's item schema allows, and whether it takes free text too."""
    options = [items, *items.get("anyOf", [])]
    values = list(dict.fromkeys(v for o in options for v in o.get("enum", [])))
    return values, any(o.get("type") == "string" and "enum" not in o for o in options)


def example(schema: Mapping, configured: Mapping[str, Sequence[str]], placeholder: str = "example") -> dict:
    """A worked answer: configured values, else the first allowed, else a placeholder.

    Raises ValueError where a configured value is not allowed or a minimum is not met.
    """
    out = {}
    for name, rule in schema["properties"].items():
        array = rule["properties"]["values"]
        allowed, free = allowed_values(array["items"])
        values = list(configured.get(name, []))
        if not values:
            values = allowed[:1] or ([placeholder] if array.get("minItems", 0) else [])
        wrong = [v for v in values if allowed and not free and v not in allowed]
        if wrong or len(values) < array.get("minItems", 0):
            raise ValueError(f"{name}: {wrong or 'too few values'}")
        out[name] = {"values": values, "reasoning": f"The abstract states {name.replace('_', ' ')}."}
    return out
