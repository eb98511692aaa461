"""Semi-structured keyword, suggestion and probability columns (J1 to J11), without Python workers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WS = " \t\n\r\f\x0b"
_STRICT = {"allowSingleQuotes": "false", "mode": "PERMISSIVE"}
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_WS))


def number(c: Column) -> Column:
    """A number written as text, NULL for anything else (Java's suffixes like ``1d`` included)."""
    return F.when(strip(c).rlike(_NUMBER), strip(c).try_cast("double"))


def comma_split(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), strip), lambda x: x != "")


def keyword_list(cell: Column, min_confidence: float = 0.0, types: tuple[str, ...] | None = None, min_probability: float = 0.5) -> Column:
    """The keywords of a cell.

    NULL and blank give an empty list; text that starts with ``[`` is strict
    JSON, else split at commas; a list of objects is read by the key of its
    first object, ``term`` (filtered by confidence and type, unique, lower case)
    or ``topic_descriptor`` (by probability, unique, lower case); other objects
    give an empty list.
    """
    t = strip(cell)
    objects = F.from_json(t, "array<struct<term:string,type:string,confidence:string,topic_descriptor:string,probability:string>>", _STRICT)
    texts = F.from_json(t, "array<string>", _STRICT)
    first = F.try_element_at(objects, F.lit(1))
    lowered = lambda arr, f: F.array_distinct(F.filter(F.transform(arr, lambda x: strip(F.lower(x[f]))), lambda x: x.isNotNull() & (x != "")))
    by_term = objects
    if min_confidence > 0:
        by_term = F.filter(by_term, lambda x: number(x["confidence"]) >= min_confidence)
    if types:
        by_term = F.filter(by_term, lambda x: x["type"].isin(*types))
    by_topic = F.filter(objects, lambda x: number(x["probability"]) >= min_probability)
    plain = F.filter(F.transform(texts, strip), lambda x: x.isNotNull() & (x != ""))
    is_objects = t.rlike(r"^\[\s*\{")
    listed = F.when(is_objects, F.when(first["term"].isNotNull(), lowered(by_term, "term")).when(first["topic_descriptor"].isNotNull(), lowered(by_topic, "topic_descriptor")).otherwise(F.array().cast("array<string>"))).otherwise(plain)
    closed = t.rlike(r"^\[[\s\S]*\]$")  # the reader accepts text after the list, JSON doesn't
    return F.when(cell.isNull() | (t == ""), F.array().cast("array<string>")).when(t.startswith("[") & closed & texts.isNotNull(), listed).otherwise(comma_split(cell))


SUGGESTION = "array<struct<term:string,type:string,confidence:string>>"


def suggestions(cell: Column) -> Column:
    """A suggestion list from JSON, else from JSON with single quotes for double ones, else empty."""
    return F.coalesce(F.from_json(cell, SUGGESTION, _STRICT), F.from_json(F.translate(cell, "'", '"'), SUGGESTION, _STRICT), F.from_json(F.lit("[]"), SUGGESTION))


def at_least(items: Column, field: str = "confidence", least: float = 0.7) -> Column:
    """Items whose numeric field is at least ``least``; missing and unreadable ones are dropped."""
    return F.filter(items, lambda x: number(x[field]) >= least)


def unique_terms(items: Column, field: str = "term") -> Column:
    """Lower-cased, stripped terms in order of first occurrence."""
    return F.array_distinct(F.filter(F.transform(items, lambda x: strip(F.lower(x[field]))), lambda x: x.isNotNull() & (x != "")))


def selected_terms(items: Column, types: tuple[str, ...], least: float = 0.0) -> Column:
    """Terms of the given types with at least this confidence, neither normalised nor unique."""
    return F.transform(F.filter(items, lambda x: (F.coalesce(number(x["confidence"]), F.lit(0.0)) >= least) & x["type"].isin(*types)), lambda x: x["term"])


def last_wins(keys: Column, values: Column) -> Column:
    """JSON object from parallel lists; of a repeated key the last value stays."""
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    n = F.size(keys)
    kept = F.filter(F.transform(pairs, lambda p, i: F.struct(p["k"].alias("k"), p["v"].alias("v"), i.alias("i"))), lambda p: ~F.exists(F.slice(keys, p["i"] + 2, n), lambda k: k == p["k"]))
    return F.to_json(F.map_from_entries(F.transform(kept, lambda p: F.struct(p["k"], p["v"]))))


def version_hash(*parts: Column) -> Column:
    """Eight hex digits that name a set of parameters."""
    return F.substring(F.md5(F.to_json(F.struct(*parts))), 1, 8)
