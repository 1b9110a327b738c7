"""Canonical JSON: sorted keys, no blanks, everything beyond ASCII escaped; and signatures over it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Control characters with a short escape; all others, and all beyond ASCII, are written as units of UTF-16.
SHORT = {"\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t", '"': '\\"', "\\": "\\\\"}
PLAIN = r"^[\x20\x21\x23-\x5B\x5D-\x7E]*\z"


def json_string(text: Column) -> Column:
    """A JSON string in ASCII; ``null`` for null."""
    units = lambda c: F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-16BE"))), "(.{4})", r"\\u$1")
    known = F.create_map(*[F.lit(x) for pair in SHORT.items() for x in pair])
    each = lambda c: F.when(c.rlike(PLAIN), c).otherwise(F.coalesce(F.element_at(known, c), units(c)))
    escaped = F.when(text.rlike(PLAIN), text).otherwise(F.array_join(F.transform(F.split(text, ""), each), ""))
    return F.coalesce(F.concat(F.lit('"'), escaped, F.lit('"')), F.lit("null"))


def json_strings(texts: Column) -> Column:
    """A JSON array of strings; an empty one for null."""
    return F.concat(F.lit("["), F.array_join(F.transform(F.coalesce(texts, F.array().cast("array<string>")), json_string), ","), F.lit("]"))


def json_object(**fields: Column) -> Column:
    """A JSON object of fields that are JSON already, by name."""
    parts = [p for i, name in enumerate(sorted(fields)) for p in (F.lit(f'{"," if i else ""}"{name}":'), fields[name])]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def signature(payload: Column) -> Column:
    return F.sha2(payload, 256)
