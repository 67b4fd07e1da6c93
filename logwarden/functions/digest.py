"""Canonical JSON and SHA-256 digests without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import CANON_FIELDS, CANON_FLAGS, CANON_V3

_SHORT_ESCAPES = {
    "0022": '\\"',
    "005c": "\\\\",
    "0008": "\\b",
    "0009": "\\t",
    "000a": "\\n",
    "000c": "\\f",
    "000d": "\\r",
}


def json_string(value: Column) -> Column:
    """A JSON string literal with every character outside printable ASCII escaped.

    Printable ASCII needs two replacements only. Anything else goes through its UTF-16 code units,
    which gives surrogate pairs for characters beyond the basic plane.
    """
    plain = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    units = F.regexp_extract_all(
        F.lower(F.hex(F.encode(value, "UTF-16BE"))), F.lit("(....)"), 1
    )

    def escape(unit: Column) -> Column:
        chosen = F
        for code, text in _SHORT_ESCAPES.items():
            chosen = chosen.when(unit == code, F.lit(text))
        return chosen.when(
            unit.between("0020", "007e"), F.char(F.conv(unit, 16, 10).cast("long"))
        ).otherwise(F.concat(F.lit("\\u"), unit))

    escaped = F.array_join(F.transform(units, escape), "")
    body = F.when(value.rlike(r"^[ -~]*\z"), plain).otherwise(escaped)
    return F.concat(F.lit('"'), body, F.lit('"'))


def canonical_payload(fields: dict[str, Column], canon: str = CANON_V3) -> Column:
    """Sorted-key JSON with ``", "`` and ``": "`` separators over the fields pinned by ``canon``."""
    parts: list[Column] = [F.lit("{")]
    for i, name in enumerate(sorted(CANON_FIELDS[canon])):
        value = fields[name]
        if name in CANON_FLAGS:
            text = F.when(F.coalesce(value.cast("boolean"), F.lit(False)), "1").otherwise("0")
        elif name in ("id", "ts_ms"):
            text = value.cast("string")
        else:
            text = json_string(value.cast("string"))
        parts.append(F.lit((", " if i else "") + f'"{name}": '))
        parts.append(F.coalesce(text, F.lit("null")))
    return F.concat(*parts, F.lit("}"))


def payload_text(fields: dict[str, Column], canon: Column) -> Column:
    """Canonical payload under the version each row records; null for an unknown version."""
    chosen = F
    for name in CANON_FIELDS:
        chosen = chosen.when(canon == name, canonical_payload(fields, name))
    return chosen


def block_hash(height: Column, ts_ms: Column, prev_hash: Column, payload_digest: Column) -> Column:
    return F.sha2(
        F.concat(
            height.cast("string"), F.lit("|"), ts_ms.cast("string"), F.lit("|"),
            prev_hash, F.lit("|"), payload_digest,
        ),
        256,
    )
