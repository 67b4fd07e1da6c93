"""Personal data by weak supervision, in DataFrame functions only.

Base patterns give spans that always stay. Their rejects, and looser forms between them, are candidates for more. Three labelers
vote on every candidate and base span: the validator of the pattern, a gazetteer and the words around. All votes of the
corpus are counted by pattern; expectation-maximisation over these few counts estimates how reliable each labeler is,
without labels. The soft labels then train a naive Bayes span classifier on shape and context features, again from counts
over all spans, and candidates that it accepts are added. Only the tables of counts, of bounded size, reach the driver.

Secrets (keys, tokens, passwords) are a further kind without a base pattern: every run of 16 or more letters and digits is a
candidate, and only the votes and the classifier decide on it.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .registry import query, table
from .store import stored

KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("secret",)  # without base spans
ALL_KINDS = KINDS + ADDED_KINDS
ACCEPT = 0.95
ROUNDS = 50
HASHES = 32  # buckets of the word before a span

# Base patterns. Possessive repeats and a look behind only spare the engine what cannot match, on long runs too.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{16,}+",
}
# What a text must hold for the pattern to match at all.
HINT = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]", "secret": r"[A-Za-z0-9_-]{16}"}
# Looser forms, looked for between the base matches of their kind.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
}
LOOSE_HINT = {"email": r"[(\[]at[)\]]", "phone": r"[0-9]{3}[\x20.-][0-9]{4}"}

# Gazetteers.
DOMAINS = r"(?i)[.\x20)\]](?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu|it|nl|ch|at|br|mx|ca|au)$"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|35|6011|65)"
ROUTABLE = r"^0*(?:[1-9]|[1-9][0-9]|1[01][0-9]|12[0-689]|1[3-9][0-9]|2[01][0-9]|22[0-3])\."
CODES = r"^\+?\(?(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
# Words around a span that speak for personal data, or for another number.
FOR = r"(?i)\b(?:e-?mail|mail|contact|write|phone|tel|call|mobile|fax|card|visa|credit|payment|pay|ip|host|server|address|client|correo|courriel|telefon|telefono|carte|karte|adresse)\b"
AGAINST = r"(?i)\b(?:version|release|isbn|issn|doi|order|invoice|serial|build|section|chapter|page|figure|token|key|hash|id)\b"
# For secrets: prefixes of issued keys, digests and mixed strings, names made of words, and the word just before.
PREFIXES = r"^(?:sk|pk|rk|ghp|gho|ghs|glpat|xox[abp]|AKIA|ASIA|AIza|eyJ|ya29)"
MIXED = r"^(?:[0-9a-f]{32,}|[0-9A-F]{32,}|(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9])[A-Za-z0-9_-]{20,})$"
WORDY = r"^[A-Za-z]+[_-]?[0-9]{1,4}$|[A-Za-z]{4,}[_-][A-Za-z]{4,}"
SECRET_FOR = r"(?i)\b(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|key|auth|bearer|credential)s?\b[^A-Za-z0-9]*$"
SECRET_AGAINST = r"(?i)\b(?:sha-?[0-9]*|md5|hash|checksum|digest|commit|etag|version|build|id)\b[^A-Za-z0-9]*$"

SPAN = "struct<start:bigint,end:bigint,value:string,before:string,after:string,strict:int>"


def _sums(lengths: str) -> Column:
    """Sums of all earlier elements of an array, in blocks of 128 so that long arrays stay cheap."""
    block = F.lit(128)
    ids = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(lengths) / block).cast("int") - 1, F.lit(0)))
    zero = F.lit(0).cast("long")

    def total(part: Column) -> Column:
        return F.aggregate(part, zero, lambda acc, x: acc + x)

    blocks = F.transform(ids, lambda b: total(F.slice(lengths, b * block + 1, block)))
    bases = F.aggregate(blocks, F.array(zero), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x))
    return F.struct(bases.alias("bases"))


def _start(sums: str, lengths: str, i: Column) -> Column:
    low = F.floor(i / 128).cast("int")
    inner = F.aggregate(F.slice(lengths, low * 128 + 1, i % 128), F.lit(0).cast("long"), lambda acc, x: acc + x)
    return F.get(F.col(f"{sums}.bases"), low) + inner


def valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$")
    if kind == "phone":
        return F.length(digits).between(8, 15)
    figure = F.transform(F.split(F.reverse(digits), ""), lambda d, i: d.cast("int") * (1 + i % 2))
    luhn = F.aggregate(figure, F.lit(0), lambda acc, x: acc + F.when(x > 9, x - 9).otherwise(x))
    return F.when(F.length(digits).between(16, 19), luhn % 10 == 0).otherwise(False)


def _strict(kind: str, value: Column) -> Column:
    """The validator's vote."""
    if kind == "secret":
        return F.when(value.rlike(MIXED), 1).when(value.rlike(WORDY), -1).otherwise(0)
    return F.when(valid(kind, value), 1).otherwise(-1)


def _split(df: DataFrame, text: str, pattern: str, hint: str, name: str) -> DataFrame:
    """Columns <name>_gaps, _hits, _lengths (of gaps and hits in turn) and _sums of one pattern."""
    there = F.col(text).rlike(hint)
    df = df.withColumn(f"{name}_gaps", F.when(there, F.split(text, pattern, -1)).otherwise(F.array(text)))
    df = df.withColumn(
        f"{name}_hits", F.when(there, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    )
    gap, hit = F.col(f"{name}_gaps"), F.col(f"{name}_hits")
    lengths = F.flatten(
        F.transform(gap, lambda g, i: F.array(F.length(g).cast("long"), F.coalesce(F.length(F.get(hit, i)), F.lit(0)).cast("long")))
    )
    return df.withColumn(f"{name}_lengths", lengths).withColumn(f"{name}_sums", _sums(f"{name}_lengths"))


def _spans(name: str, kind: str) -> Column:
    gap = F.col(f"{name}_gaps")

    def span(value: Column, i: Column) -> Column:
        start = _start(f"{name}_sums", f"{name}_lengths", i * 2 + 1)
        return F.struct(
            start.alias("start"),
            (start + F.length(value)).alias("end"),
            value.alias("value"),
            F.right(F.get(gap, i), F.lit(40)).alias("before"),
            F.left(F.get(gap, i + 1), F.lit(12)).alias("after"),
            _strict(kind, value).alias("strict"),
        )

    return F.transform(f"{name}_hits", span)


def _loose_spans(df: DataFrame, kind: str) -> Column:
    """Looser forms inside the gaps between base matches, placed by their gap."""
    gap = F.col(f"{kind}_gaps")
    pattern = F.lit(LOOSE[kind])

    def inside(g: Column, i: Column) -> Column:
        start = _start(f"{kind}_sums", f"{kind}_lengths", i * 2)
        pieces = F.split(g, LOOSE[kind], -1)
        hits = F.regexp_extract_all(g, pattern, F.lit(0))

        def span(value: Column, j: Column) -> Column:
            at = start + F.aggregate(
                F.sequence(F.lit(0), j),
                F.lit(0).cast("long"),
                lambda acc, x: acc + F.length(F.get(pieces, x)) + F.when(x < j, F.length(F.get(hits, x))).otherwise(0),
            )
            return F.struct(
                at.alias("start"),
                (at + F.length(value)).alias("end"),
                value.alias("value"),
                F.right(F.get(pieces, j), F.lit(40)).alias("before"),
                F.left(F.get(pieces, j + 1), F.lit(12)).alias("after"),
                F.lit(0).alias("strict"),
            )

        return F.when(g.rlike(LOOSE_HINT[kind]), F.transform(hits, span)).otherwise(F.array().cast(f"array<{SPAN}>"))

    return F.flatten(F.transform(gap, inside))


def _vote(yes: Column, no: Column | None = None) -> Column:
    vote = F.when(yes, 1)
    return (vote.when(no, -1) if no is not None else vote).otherwise(0)


def gazetteer(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "email":
        return _vote(value.rlike(DOMAINS), F.lit(True))
    if kind == "ip":
        return _vote(value.rlike(ROUTABLE), F.lit(True))
    if kind == "card":
        return _vote(digits.rlike(ISSUERS), F.lit(True))
    if kind == "secret":
        return _vote(value.rlike(PREFIXES))
    return _vote(value.rlike(CODES))


def _char_class(c: Column) -> Column:
    return (
        F.when(F.coalesce(c, F.lit("")) == "", "none").when(c.rlike(r"[\s]"), "space").when(c.rlike("[A-Za-z]"), "letter")
        .when(c.rlike("[0-9]"), "digit").when(c.rlike("[=:\"'#/_]"), "code").otherwise("other")
    )


def _features(span: Column) -> Column:
    word = F.regexp_extract(span.before, r"(\S+)\s*$", 1)
    return F.array(
        F.concat(F.lit("left:"), _char_class(F.right(span.before, F.lit(1)))),
        F.concat(F.lit("right:"), _char_class(F.left(span.after, F.lit(1)))),
        F.concat(F.lit("size:"), F.least(F.floor(F.length(span.value) / 4), F.lit(10)).cast("string")),
        F.concat(F.lit("marks:"), F.least(F.length(F.regexp_replace(span.value, "[A-Za-z0-9]", "")), F.lit(6)).cast("string")),
        F.concat(F.lit("word:"), (F.pmod(F.xxhash64(F.lower(word)), F.lit(HASHES))).cast("string")),
        F.concat(F.lit("strict:"), span.strict.cast("string")),
    )


def _voted(kind: str) -> Column:
    """The spans of a kind with the other labelers' votes and the features."""

    def span(s: Column) -> Column:
        speaks, against = (SECRET_FOR, SECRET_AGAINST) if kind == "secret" else (FOR, AGAINST)
        context = _vote(s.before.rlike(speaks), s.before.rlike(against))
        return F.struct(
            s.start.alias("start"), s.end.alias("end"), s.strict.alias("strict"), gazetteer(kind, s.value).alias("listed"),
            context.alias("context"), _features(s).alias("features"),
        )

    return F.transform(f"{kind}_raw", span)


def _tagged(kind: str) -> Column:
    return F.transform(kind, lambda s: F.struct(F.lit(kind).alias("kind"), s.alias("s")))


def find_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and, per kind, an array of spans: base matches, their rejects and looser forms, with votes and features."""
    df = docs.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    for kind in ALL_KINDS:
        df = _split(df, "text", BASE[kind], HINT[kind], kind)
        spans = _spans(kind, kind)
        df = df.withColumn(f"{kind}_raw", F.concat(spans, _loose_spans(df, kind)) if kind in LOOSE else spans)
        if kind == "card":  # other digit runs are no candidates
            df = df.withColumn("card_raw", F.filter("card_raw", lambda s: F.length(F.regexp_replace(s.value, "[^0-9]", "")).between(13, 19)))
        if kind == "secret":  # plain words and plain numbers are no candidates
            df = df.withColumn("secret_raw", F.filter("secret_raw", lambda s: s.value.rlike("[0-9]") & s.value.rlike("[A-Za-z]")))
        df = df.withColumn(kind, _voted(kind))
    return df.select("key", *ALL_KINDS)


def count_votes(spans: DataFrame) -> list[Row]:
    """(kind, strict, listed, context, feature, n): at most 135 vote patterns times about 70 features."""
    tagged = F.flatten(F.array(*[_tagged(kind) for kind in ALL_KINDS]))
    rows = spans.select(F.explode(tagged).alias("t")).select(
        "t.kind", "t.s.strict", "t.s.listed", "t.s.context", F.explode(F.concat(F.array(F.lit("all")), F.col("t.s.features"))).alias("feature")
    )
    return rows.groupBy("kind", "strict", "listed", "context", "feature").agg(F.count("*").alias("n")).collect()


def estimate(counts: list[Row], rounds: int = ROUNDS) -> tuple[dict[str, float], dict[tuple[str, str], float]]:
    """Per kind a prior logit, and per (kind, feature) a log ratio, of the final classifier.

    Expectation-maximisation: given the truth, labelers vote independently; each one's vote rates are re-estimated from
    the soft labels of all vote patterns, starting from the belief that votes are mostly right.
    """
    prior: dict[str, float] = {}
    ratio: dict[tuple[str, str], float] = {}
    for kind in ALL_KINDS:
        patterns: dict[tuple[int, int, int], float] = defaultdict(float)
        for r in counts:
            if r.kind == kind and r.feature == "all":
                patterns[r.strict, r.listed, r.context] += r.n
        if not patterns:
            continue
        total = sum(patterns.values())
        belief = {1: {1: 0.6, 0: 0.3, -1: 0.1}, 0: {1: 0.2, 0: 0.3, -1: 0.5}}
        rates = [{y: dict(belief[y]) for y in (0, 1)} for _ in range(3)]
        share, soft = 0.5, {}
        for _ in range(rounds):
            for votes in patterns:
                one, zero = share, 1 - share
                for labeler, vote in enumerate(votes):
                    one *= rates[labeler][1][vote]
                    zero *= rates[labeler][0][vote]
                soft[votes] = one / (one + zero)
            mass = {1: sum(n * soft[v] for v, n in patterns.items())}
            mass[0] = total - mass[1]
            share = (mass[1] + 1) / (total + 2)
            for labeler in range(3):
                for y in (0, 1):
                    for vote in (-1, 0, 1):
                        seen = sum(n * (soft[v] if y else 1 - soft[v]) for v, n in patterns.items() if v[labeler] == vote)
                        rates[labeler][y][vote] = (seen + 4 * belief[y][vote]) / (mass[y] + 4)
        prior[kind] = math.log(share / (1 - share))
        held: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
        for r in counts:
            if r.kind == kind and r.feature != "all":
                p = soft[r.strict, r.listed, r.context]
                held[r.feature][0] += r.n * (1 - p)
                held[r.feature][1] += r.n * p
        for feature, (no, yes) in held.items():
            ratio[kind, feature] = math.log((yes + 1) / (mass[1] + 10)) - math.log((no + 1) / (mass[0] + 10))
    return prior, ratio


def label_spans(spans: DataFrame, model: tuple[dict[str, float], dict[tuple[str, str], float]], accept: float = ACCEPT) -> DataFrame:
    """key and, per kind, base (start, end) and added (start, end) arrays, each by start."""
    prior, ratio = model
    out = [F.col("key")]
    for kind in ALL_KINDS:
        stays = (lambda s: s.strict == 1) if kind in KINDS else (lambda s: F.lit(False))
        out.append(F.transform(F.filter(kind, stays), lambda s: F.struct(s.start.alias("start"), s.end.alias("end"))).alias(f"{kind}_base"))
        own = {feature: w for (k, feature), w in ratio.items() if k == kind}
        pairs = [x for feature, w in sorted(own.items()) for x in (F.lit(feature), F.lit(w))]
        weight = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,double>")

        def score(s: Column, weight=weight, kind=kind) -> Column:
            return F.aggregate(s.features, F.lit(float(prior.get(kind, 0.0))), lambda acc, f: acc + F.coalesce(F.try_element_at(weight, f), F.lit(0.0)))

        limit = math.log(accept / (1 - accept))
        added = F.filter(kind, lambda s: F.when(stays(s), False).otherwise(score(s) >= limit))
        out.append(F.array_sort(F.transform(added, lambda s: F.struct(s.start.alias("start"), s.end.alias("end")))).alias(f"{kind}_added"))
    return spans.select(*out)


def personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and arrays <kind>_base and <kind>_added of (start, end), in code points, for email, ip, card, phone and secret.

    One row per row of ``docs``, repeated rows and null keys included; null or empty text has no spans, an empty table gives
    no rows, other columns are not read. Added spans of a kind do not overlap its base spans; secret has no base.
    """
    spans = stored(find_spans(docs, key, text), "spans")
    return label_spans(spans, estimate(count_votes(spans))).withColumnRenamed("key", key)


def _listed(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s.start.cast("string"), s.end.cast("string")))


@query("op2_pii")
def pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    base = F.concat(*[_listed(k, F.col(f"{k}_base")) for k in KINDS])
    both = F.concat(*[_listed(k, F.array_sort(F.concat(f"{k}_base", f"{k}_added"))) for k in ALL_KINDS])
    return found.select(
        "doc_id",
        *[F.size(f"{k}_base").cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(both, ",").alias("spans"),
        F.size("secret_added").cast("long").alias("n_secret"),
        F.size(both).cast("long").alias("n_spans"),
    )
