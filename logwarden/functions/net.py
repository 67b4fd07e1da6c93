"""IP address forms and arithmetic, CIDR bounds and address scope as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import SCOPE_RANGES

OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4_STRICT = rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}\z"
LOOPBACK_V6 = ("::1", "0:0:0:0:0:0:0:1")


def dotted_to_long(a: int, b: int, c: int, d: int) -> int:
    return ((a * 256 + b) * 256 + c) * 256 + d


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, evaluated once and written into generated code once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def settled(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with the column ``name``, evaluated once per row where it stands.

    A later filter on a plain column would be pushed below every earlier stage, with all of them written out again
    inside it. A generator's output is filtered above it, while filters on other columns still pass to the source.
    """
    others = [F.col(f"`{c}`") for c in df.columns if c != name]
    return df.select(*others, F.explode(F.array(value)).alias(name))


def ip_to_long(ip: Column) -> Column:
    """IPv4 text to its 32-bit value; null unless the text is a strict dotted quad."""
    value = F.aggregate(
        F.split(ip, r"\."), F.lit(0).cast("long"), lambda acc, part: acc * 256 + part.cast("long")
    )
    return F.when(ip.rlike(IPV4_STRICT), value)


def long_to_ip(value: Column) -> Column:
    octets = F.transform(
        F.array(*[F.lit(s) for s in (24, 16, 8, 0)]),
        lambda s: F.pmod(F.floor(value / F.pow(F.lit(2.0), s)), F.lit(256)).cast("long").cast("string"),
    )
    return F.when(value.isNotNull(), F.array_join(octets, "."))


def cidr_bounds(text: Column) -> Column:
    """``a.b.c.d[/n | /mask]`` to struct(lo, hi) with host bits masked off; null if not IPv4."""
    return let(text, _cidr_bounds)


def _cidr_bounds(text: Column) -> Column:
    tail = F.when(F.instr(text, "/") > 0, F.substring(text, F.instr(text, "/") + 1, F.length(text)))
    bits = F.when(tail.isNull(), F.lit(32)).when(tail.rlike(r"^[0-9]{1,2}\z"), tail.try_cast("int"))
    parts = F.struct(
        ip_to_long(F.substring_index(text, "/", 1)).alias("head"),
        F.when(bits.between(0, 32), F.pow(F.lit(2.0), 32 - bits).cast("long") - 1).alias("span"),
        # Netmask and hostmask notations are accepted too: /255.255.0.0 and /0.0.255.255.
        ip_to_long(tail).alias("mask"),
    )

    def bounds(p: Column) -> Column:
        inverse = F.lit(0xFFFFFFFF) - p["mask"]
        span = (
            F.when(p["span"].isNotNull(), p["span"])
            .when(inverse.bitwiseAND(inverse + 1) == 0, inverse)
            .when(p["mask"].bitwiseAND(p["mask"] + 1) == 0, p["mask"])
        )
        return let(
            F.struct(p["head"].alias("head"), span.alias("span")),
            lambda q: F.when(
                q["head"].isNotNull() & q["span"].isNotNull(),
                F.struct(
                    (q["head"] - q["head"].bitwiseAND(q["span"])).alias("lo"),
                    (q["head"] - q["head"].bitwiseAND(q["span"]) + q["span"]).alias("hi"),
                ),
            ),
        )

    return let(parts, bounds)


def _range_of(network: str, bits: int) -> tuple[int, int]:
    lo = dotted_to_long(*(int(x) for x in network.split(".")))
    return lo, lo + 2 ** (32 - bits) - 1


def ip_scope(ip_long: Column) -> Column:
    """struct(scope, detail) of a 32-bit address; a null address stays null."""

    def label(scope: str, detail: str) -> Column:
        return F.struct(F.lit(scope).alias("scope"), F.lit(detail).alias("detail"))

    def find(address: Column) -> Column:
        found = F
        for network, bits, scope, detail in SCOPE_RANGES:
            found = found.when(address.between(*_range_of(network, bits)), label(scope, detail))
        return found.when(address.isNotNull(), label("global", "globally routable"))

    return let(ip_long, find)


def canonical_ipv6(text: Column) -> Column:
    """Canonical form of an IPv6 literal without zone, mapped IPv4 unwrapped; null if it is none.

    Groups in lower-case hex without leading zeros, the first longest run of two or more zero groups as "::".
    """
    return let(text, lambda t: let(_ipv6_groups(_hex_tail(t)), _ipv6_text))


def _hex_tail(text: Column) -> Column:
    """The literal with a dotted quad at its end written as two groups."""
    last = F.substring_index(text, ":", -1)
    head = F.substring(text, F.lit(1), F.length(text) - F.length(last))

    def two(tail: Column) -> Column:
        groups = F.concat_ws(":", F.hex(F.shiftright(tail, 16)), F.hex(tail.bitwiseAND(0xFFFF)))
        return F.when(tail.isNotNull(), F.concat(head, groups))

    return F.when(F.instr(text, ".") > 0, let(ip_to_long(last), two)).otherwise(text)


def _ipv6_groups(text: Column) -> Column:
    """The eight groups as numbers, or null."""
    none = F.array().cast("array<string>")

    def part(half: Column) -> Column:
        return F.when(half == "", none).otherwise(F.split(half, ":", -1))

    def whole(p: Column) -> Column:
        short = F.size(p["left"]) + F.size(p["right"])
        return F.when((p["halves"] == 1) & (F.size(p["left"]) == 8), p["left"]).when(
            (p["halves"] == 2) & (short < 8),
            F.concat(p["left"], F.array_repeat(F.lit("0"), F.greatest(8 - short, F.lit(0))), p["right"]),
        )

    def parts(halves: Column) -> Column:
        left, right = part(F.get(halves, F.lit(0))), part(F.get(halves, F.lit(1)))
        return F.struct(left.alias("left"), right.alias("right"), F.size(halves).alias("halves"))

    def numbers(groups: Column) -> Column:
        sound = F.forall(groups, lambda g: g.rlike(r"^[0-9A-Fa-f]{1,4}\z"))
        return F.when(sound, F.transform(groups, lambda g: F.conv(g, 16, 10).cast("long")))

    return let(let(let(F.split(text, "::", -1), parts), whole), numbers)


def _ipv6_text(groups: Column) -> Column:
    zeros = F.array_join(F.transform(groups, lambda g: F.when(g == 0, "0").otherwise("1")), "")
    return let(zeros, lambda found: _ipv6_written(groups, found))


def _ipv6_written(groups: Column, zeros: Column) -> Column:
    names = F.transform(groups, lambda g: F.lower(F.hex(g)))
    found = F
    for size in range(8, 1, -1):
        run = "0" * size
        start = F.instr(zeros, run)
        head, tail = F.slice(names, F.lit(1), start - 1), F.slice(names, start + size, F.lit(8))
        found = found.when(start > 0, F.concat(F.array_join(head, ":"), F.lit("::"), F.array_join(tail, ":")))
    mapped = zeros.startswith("000001") & (F.get(groups, F.lit(5)) == 0xFFFF)
    quad = long_to_ip(F.get(groups, F.lit(6)) * 65536 + F.get(groups, F.lit(7)))
    plain = found.otherwise(F.array_join(names, ":"))
    return F.when(groups.isNotNull(), F.when(mapped, quad).otherwise(plain))


def canonical_ip(text: Column, ipv6: bool = True) -> Column:
    """The address as written by its family's canonical form; null when it is not an address.

    With ``ipv6=False`` addresses with a colon come out as null.
    """
    v4 = F.when(text.rlike(IPV4_STRICT), text)
    if not ipv6:
        return v4
    return F.coalesce(v4, F.when(F.instr(text, ":") > 0, canonical_ipv6(text)))


def loopback_among(peers: tuple[str, ...]) -> tuple[str, ...]:
    """The fixed addresses that ``is_loopback`` holds for, told without looking at rows."""
    return tuple(p for p in peers if p in LOOPBACK_V6 or (re.fullmatch(IPV4_STRICT[1:-2], p) and p.startswith("127.")))


def is_loopback(ip: Column) -> Column:
    return F.coalesce(ip_to_long(ip).between(*_range_of("127.0.0.0", 8)), F.lit(False)) | (
        F.coalesce(ip.isin(*LOOPBACK_V6), F.lit(False))
    )
