"""Text predicates and extractions as Column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import (
    BLOCK_ID,
    BLOCK_LINE_HEAD,
    ERROR_WORDS,
    EVENT_META,
    DEFAULT_META,
    IPV4_IN_TEXT,
    LEVEL_EVENTS,
    MONTHS,
    SERVICE_ACCOUNTS,
    SUCCESSFUL_SU,
    SYSLOG_FACILITIES,
    SYSLOG_SEVERITY_EVENTS,
    TEMPLATE_MASKS,
    WARNING_WORDS,
)
from .net import let


def lookup(mapping: dict, key: Column) -> Column:
    """A small constant map as an expression; null for an absent key."""
    entries = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.try_element_at(F.create_map(*entries), key)


def event_severity(event: Column) -> Column:
    return F.coalesce(lookup({k: v[0] for k, v in EVENT_META.items()}, event), F.lit(DEFAULT_META[0]))


def event_category(event: Column) -> Column:
    return F.coalesce(lookup({k: v[1] for k, v in EVENT_META.items()}, event), F.lit(DEFAULT_META[1]))


def level_event(level: Column) -> Column:
    return F.coalesce(lookup(LEVEL_EVENTS, F.upper(level)), F.lit("log_info"))


def _contains_any(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike("|".join(re.escape(w) for w in words))


def keyword_level(message: Column) -> Column:
    """Event name from the words a message contains: error words first, then warning words."""
    return let(
        F.lower(message),
        lambda low: F.when(_contains_any(low, ERROR_WORDS), "log_error")
        .when(_contains_any(low, WARNING_WORDS), "log_warning")
        .otherwise("log_info"),
    )


def first_ipv4(text: Column, strict: bool = True) -> Column:
    """First valid IPv4 in the text; ``strict`` also refuses leading zeros in an octet."""
    octet = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    if not strict:
        octet = r"(25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
    valid = rf"^{octet}\.{octet}\.{octet}\.{octet}\z"
    hits = F.regexp_extract_all(text, F.lit(IPV4_IN_TEXT), 0)
    return F.get(F.filter(hits, lambda h: h.rlike(valid)), F.lit(0))


def month_number(name: Column) -> Column:
    position = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), name)
    return F.nullif(position, F.lit(0).cast("long")).cast("int")


def clock_timestamp(year: Column, month: Column, day: Column, hhmmss: Column) -> Column:
    """UTC timestamp of calendar parts; null when they name no real time."""
    padded = lambda part, n: F.lpad(part.cast("int").cast("string"), n, "0")
    date = F.concat(padded(year, 4), F.lit("-"), padded(month, 2), F.lit("-"), padded(day, 2))
    return F.when(month.isNotNull() & year.between(0, 9999), F.try_to_timestamp(F.concat(date, F.lit(" "), hhmmss)))


def pri_facility(pri: Column) -> Column:
    code = F.floor(pri / 8).cast("int")
    names = F.array(*[F.lit(n) for n in SYSLOG_FACILITIES])
    return F.coalesce(F.get(names, code), F.concat(F.lit("facility"), code.cast("string")))


def pri_severity(pri: Column) -> Column:
    return F.pmod(pri, F.lit(8)).cast("int")


def severity_event(code: Column) -> Column:
    return F.get(F.array(*[F.lit(n) for n in SYSLOG_SEVERITY_EVENTS]), code)


def service_account_su(tag: Column, message: Column) -> Column:
    """The service account that switched to another user, or null."""
    target = F.regexp_extract(message, SUCCESSFUL_SU, 1)
    actor = F.regexp_extract(message, SUCCESSFUL_SU, 2)
    return F.when(tag == "su", service_actor(target, actor))


def service_actor(target: Column, actor: Column) -> Column:
    """The actor, if it is a service account that became somebody else."""
    return F.when(actor.isin(*SERVICE_ACCOUNTS) & (target != actor), actor)


def stripped(text: Column) -> Column:
    """The text without white space at either end; searched only where it begins or ends with some, or is not ASCII."""
    edge = F.octet_length(text) != F.char_length(text)
    for end in (F.substring(text, 1, 1), F.substring(text, -1, 1)):
        edge = edge | end.isin(*" \t\n\x0b\x0c\r")
    return F.when(edge, F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")).otherwise(text)


def line_content(line: Column) -> Column:
    """Content after the five header fields, or the stripped line when it has no such header."""

    def content(text: Column) -> Column:
        stripped = F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")
        cut = F.nullif(F.regexp_replace(text, BLOCK_LINE_HEAD, "$1"), text)
        # Only a line that begins like a header is tried against the whole header pattern.
        return F.when(text.rlike(r"(?U)^\d{6}\s"), F.coalesce(cut, stripped)).otherwise(stripped)

    return let(line, content)


def block_ids(content: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(content, F.lit(BLOCK_ID), 0))


def mask(content: Column) -> Column:
    """Replace block ids, addresses, paths, hex and plain numbers by their mask, in that order. Each of them has a digit or a slash."""
    masked = reduce(lambda c, m: F.regexp_replace(c, m[0], m[1]), TEMPLATE_MASKS, content)
    return F.when(content.rlike(r"(?U)[\d/]"), masked).otherwise(content)


def single_spaced(text: Column) -> Column:
    """Whether the text is words with single spaces between them, and no other white space."""
    other = text.contains("  ") | text.startswith(" ") | text.endswith(" ") | text.rlike(r"(?U)[\s&&[^ ]]")
    return ~other & (text != "")


def tokens(masked: Column) -> Column:
    """Words between white space."""
    return let(
        F.regexp_replace(masked, r"(?U)^\s+|\s+\z", ""),
        lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"(?U)\s+")),
    )


def fill_template(template: Column, fields: dict[str, Column]) -> Column:
    """Fill ``{name}`` placeholders. A text with an unknown placeholder is left as it is."""
    known = "|".join(re.escape(f) for f in fields)
    unknown = template.rlike(rf"\{{(?!({known})\}})[^}}]*\}}")
    # One pass over the pieces: a filled-in value is never searched for placeholders again.
    pieces = F.regexp_extract_all(template, F.lit(rf"(\{{(?:{known})\}}|[^{{]+|\{{)"), 1)

    def fill(piece: Column) -> Column:
        chosen = F
        for name, value in fields.items():
            chosen = chosen.when(piece == F.lit("{" + name + "}"), value.cast("string"))
        return chosen.otherwise(piece)

    return F.when(unknown, template).otherwise(F.array_join(F.transform(pieces, fill), ""))


def contains_ci(column: Column, needle: str) -> Column:
    """Case-insensitive substring test; lower-casing is Unicode aware."""
    return F.instr(F.lower(column), needle.lower()) > 0
