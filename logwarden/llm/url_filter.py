"""URL filter: a bit-parallel wildcard automaton over canonical URLs.

All glob rules are packed into one multiword bit vector: one bit per literal, plus one start bit per rule. A step
is ``(state << 1 & accepts[byte]) | (state & stays[byte])``, so every rule advances at once, and a batch of URLs
advances together. ``*`` is a run without "/", ``**`` any run, ``?`` one byte other than "/".
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The rules of the contract, as (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
# Globs over "." + host + path that block a URL which no rule fits; other URLs are allowed.
BLOCK_GLOBS = (
    "*.ads.*/**",
    "*.tracker.*/**",
    "*.doubleclick.*/**",
    "**/cgi-bin/**",
    "**/wp-admin/**",
    "**/login*",
    "**/cart/*/checkout",
    "**/?ad?/**",
    "**.exe",
    "**.zip",
)

Token = int | str  # a literal byte, "?", "*" or "**"


def glob_tokens(glob: str) -> list[Token]:
    out: list[Token] = []
    data = glob.encode()
    i = 0
    while i < len(data):
        if data[i : i + 2] == b"**":
            out.append("**")
            i += 2
        else:
            out.append({0x2A: "*", 0x3F: "?"}.get(data[i], data[i]))
            i += 1
    return out


def rule_tokens(host: str, path: str) -> list[Token]:
    """A host with all its subdomains, and a path prefix; their characters are literals."""
    return ["*", *f".{host}{path}".encode(), "**"]


class Automaton:
    """Start, accept and stay masks of a list of token patterns."""

    def __init__(self, patterns: list[list[Token]]) -> None:
        bits = sum(1 + sum(t not in ("*", "**") for t in p) for p in patterns)
        self.width = max(1, -(-bits // 64))
        accepts = np.zeros((256, self.width), np.uint64)
        stays = np.zeros((256, self.width), np.uint64)
        self.start = np.zeros(self.width, np.uint64)
        self.final: list[tuple[int, np.uint64]] = []
        slash = np.arange(256) != 0x2F
        at = 0
        for pattern in patterns:
            word, bit = at >> 6, np.uint64(1 << (at & 63))
            self.start[word] |= bit
            for t in pattern:
                if t in ("*", "**"):
                    stays[slash if t == "*" else slice(None), word] |= bit
                    continue
                at += 1
                word, bit = at >> 6, np.uint64(1 << (at & 63))
                accepts[slash if t == "?" else t, word] |= bit
            self.final.append((word, bit))
            at += 1
        self.accepts, self.stays = accepts, stays

    def matches(self, column: pa.Array) -> np.ndarray:
        """A row of booleans per URL: which patterns match it whole."""
        texts = [t.encode() for t in column.to_pylist()]
        size = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-size, kind="stable")
        data = np.frombuffer(b"".join(texts), np.uint8)
        begin = (np.cumsum(size) - size)[order]
        size = size[order]
        state = np.tile(self.start, (len(texts), 1))
        for pos in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size, -pos, "left"))
            byte = data[begin[:live] + pos]
            now = state[:live]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:live] = (moved & self.accepts[byte]) | (now & self.stays[byte])
        out = np.empty((len(texts), len(self.final)), bool)
        for k, (word, bit) in enumerate(self.final):
            out[order, k] = (state[:, word] & bit) != 0
        return out


def judge_urls(
    pages: DataFrame,
    rules: tuple[tuple[str, str, str], ...] = RULES,
    block_globs: tuple[str, ...] = BLOCK_GLOBS,
    key: str = "page_id",
    url: str = "url",
) -> DataFrame:
    """One row per page row: key, host, path, rule and verdict.

    A null URL or one without "://" has empty host and path and is judged like any other. The longest fitting
    rule decides (of equal rules the first listed); without one, ``block_globs`` do. Repeated rows, null keys and
    an empty table give as many rows back; other columns of ``pages``, whatever their names, are not read.
    """
    found = F.coalesce(F.col(url), F.lit(""))
    canonical = pages.select(
        F.col(key).alias("key"),
        F.translate(F.regexp_extract(found, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER).alias("host"),
        F.regexp_extract(found, r"(?s)^.*?://[^/?#]*([^?#]*)", 1).alias("path"),
    )
    order = sorted(range(len(rules)), key=lambda i: -len(rules[i][1] + rules[i][2]))
    names = [rules[i][1] + rules[i][2] for i in order]
    verdicts = [rules[i][0] for i in order]
    patterns = [rule_tokens(*rules[i][1:]) for i in order] + [glob_tokens(g) for g in block_globs]
    key_type = pages.schema[key].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(patterns)
        for batch in batches:
            hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            hit = automaton.matches(pa.array([f".{h}{p}" for h, p in zip(hosts, paths, strict=True)], pa.string()))
            ruled = hit[:, : len(names)]
            best = np.where(ruled.any(axis=1), ruled.argmax(axis=1), -1) if names else np.full(len(hosts), -1)
            blocked = hit[:, len(names) :].any(axis=1)
            rule = [None if b < 0 else names[b] for b in best]
            verdict = [("block" if x else "allow") if b < 0 else verdicts[b] for b, x in zip(best, blocked, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                ["key", "host", "path", "rule", "verdict"],
            )

    out = canonical.mapInArrow(judge, f"key {key_type}, host string, path string, rule string, verdict string")
    return out.withColumnRenamed("key", key)


ORACLE = f"""
WITH parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), ruled AS (
  SELECT *, CASE
      WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/en/1') THEN 'example.org/en/1'
      WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/es/') THEN 'example.org/es/'
      WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/fr/') THEN 'com/fr/'
      WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/de/') THEN 'com/de/'
      WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/') THEN 'org/'
    END AS rule
  FROM parts
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('org/', 'com/fr/') THEN 'allow'
    WHEN rule IS NOT NULL THEN 'block'
    WHEN regexp_full_match('.' || host || path, '(?s)[^/]*\\.(ads|tracker|doubleclick)\\.[^/]*/.*|.*/(cgi-bin|wp-admin)/.*|.*/login[^/]*|.*/cart/[^/]*/checkout|.*/[^/]ad[^/]/.*|.*\\.(exe|zip)') THEN 'block'
    ELSE 'allow'
  END AS verdict
FROM ruled
"""


@query("op7_url_filter", ORACLE)
def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))
