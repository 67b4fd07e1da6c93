"""Queries: block logs, templates, count vectors, splits, classifiers."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import line_content
from ..operators import blocks as blk
from ..operators import metrics, models, ordering
from ..operators import templates as tpl
from ..session import cut_lineage, stored
from .catalog import query
from .testdata import sql, table

# Events rendered as block log lines. A line names the block of its run of 20 events, sometimes the
# next one too, or a long-lived block; some lines name none.
VERBS = {
    "click": "Receiving block", "view": "PacketResponder 1 for block", "purchase": "Verification succeeded for",
    "signup": "Deleting block", "error": "Got exception while serving",
}
_VERB_SQL = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in VERBS.items())
# Lines of some users open with a role, which makes more templates than any fixed width would hold.
_ROLE_SQL = "CASE user_id % 3 WHEN 0 THEN 'client:' WHEN 1 THEN 'mover:' ELSE '' END"
LOG_SQL = f"""
ln AS (
  SELECT event_id + 1 AS position, user_id, event_type,
    CASE WHEN event_id % 17 = 0 THEN [] WHEN user_id % 30 = 0 THEN ['blk_-' || (1000000 + user_id)]
      WHEN event_id % 10 = 0 THEN ['blk_' || (event_id // 20), 'blk_' || (event_id // 20 + 1)]
      ELSE ['blk_' || (event_id // 20)] END AS blocks
  FROM events
),
log AS (
  SELECT *, CASE WHEN len(blocks) = 0 THEN 'Starting periodic scan ' || position
    ELSE {_ROLE_SQL} || CASE event_type {_VERB_SQL} END || ' ' || array_to_string(blocks, ' and ') || ' size ' || position END AS content,
    CASE WHEN len(blocks) = 0 THEN 'Starting periodic scan <NUM>'
    ELSE {_ROLE_SQL} || replace(CASE event_type {_VERB_SQL} END, ' 1 ', ' <NUM> ') || ' ' || array_to_string(list_transform(blocks, lambda b: '<BLK>'), ' and ') || ' size <NUM>' END AS masked
  FROM ln
),
bl AS (SELECT position, user_id, content, masked, unnest(blocks) AS block_id FROM log),
lab AS (
  SELECT block_id, CASE WHEN n % 7 < 2 THEN 1 ELSE 0 END AS label FROM
    (SELECT block_id, CAST(regexp_extract(block_id, '[0-9]+') AS BIGINT) AS n FROM (SELECT DISTINCT block_id FROM bl)) WHERE n % 11 <> 0
)"""


def block_log(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    event_id, user = F.col("event_id"), F.col("user_id")
    run = F.floor(event_id / 20)
    names = (
        F.when(event_id % 17 == 0, F.lit(None))
        .when(user % 30 == 0, F.concat(F.lit("blk_-"), (user + 1000000).cast("string")))
        .when(event_id % 10 == 0, F.concat(F.lit("blk_"), run.cast("string"), F.lit(" and blk_"), (run + 1).cast("string")))
        .otherwise(F.concat(F.lit("blk_"), run.cast("string")))
    )
    verb = F
    for kind, words in VERBS.items():
        verb = verb.when(F.col("event_type") == kind, words)
    role = F.when(user % 3 == 0, "client:").when(user % 3 == 1, "mover:").otherwise("")
    position = event_id + 1
    content = F.when(names.isNull(), F.concat(F.lit("Starting periodic scan "), position.cast("string"))).otherwise(
        F.concat(role, verb, F.lit(" "), names, F.lit(" size "), position.cast("string"))
    )
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyMMdd HHmmss")
    line = F.concat(stamp, F.lit(" 148 INFO dfs.DataNode: "), content)
    return e.select(position.alias("position"), user.alias("user_id"), stamp.alias("stamp"), line.alias("value"))


def block_rows(spark: SparkSession, sf: str) -> DataFrame:
    return blk.block_lines(block_log(spark, sf))


def block_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of ten blocks in eleven, two in seven anomalous."""
    ids = block_rows(spark, sf).select("block_id").distinct()
    number = F.regexp_extract("block_id", "[0-9]+", 0).cast("long")
    return ids.where(number % 11 != 0).select("block_id", F.when(number % 7 < 2, 1).otherwise(0).alias("label"))


@query("block_lines", sql(LOG_SQL, "SELECT position, block_id, content FROM bl"))
def block_lines(spark: SparkSession, sf: str) -> DataFrame:
    return block_rows(spark, sf).select("position", "block_id", "content")


TEMPLATE_SQL = LOG_SQL + """,
t AS (
  SELECT masked, row_number() OVER (ORDER BY min(position)) AS template_id, min(position) AS first_pos, count(*) AS lines
  FROM log GROUP BY masked
)"""


def mined(spark: SparkSession, sf: str) -> DataFrame:
    lines = block_log(spark, sf).select("position", line_content(F.col("value")).alias("content"))
    return tpl.mine_templates(lines)


@query("mine_templates", sql(TEMPLATE_SQL, "SELECT template_id, masked AS template, first_pos, lines FROM t"))
def mine_templates(spark: SparkSession, sf: str) -> DataFrame:
    """No two line shapes of this log are similar enough to merge, so templates are the shapes."""
    return mined(spark, sf).select("template_id", tpl.template_text(F.col("tokens")).alias("template"), "first_pos", "lines")


# --- Mining in SQL: masks, leaves, and the clustering of parts in rounds -------------------------
_WORD = r"[\p{L}\p{M}\p{Nd}\p{Pc}]"
_NOT_WORD = r"[^\p{L}\p{M}\p{Nd}\p{Pc}]"


def mask_sql(text: str) -> str:
    """The five masks; a number between two others shares its borders, so numbers are replaced twice."""
    number = rf"'(^|{_NOT_WORD})\p{{Nd}}+($|{_NOT_WORD})', '\1<NUM>\2', 'g')"
    for pattern, name in (
        (r"blk_-?\p{Nd}+", "<BLK>"), (r"(\p{Nd}+\.){3}\p{Nd}+(:\p{Nd}+)?", "<IP>"),
        (r"/[-\p{L}\p{M}\p{Nd}\p{Pc}./]+", "<PATH>"), (r"0x[0-9a-fA-F]+", "<HEX>"),
    ):
        text = f"regexp_replace({text}, '{pattern}', '{name}', 'g')"
    return f"regexp_replace(regexp_replace({text}, {number}, {number}"


def mining_sql(lines: str, digits: int) -> str:
    """CTEs from ``lines`` (position, content) to ``mined`` (template_id, n, toks, first_pos, lines)."""
    ctes = [rf"""masked AS (
  SELECT masked, min(position) AS first_pos, count(*) AS lines FROM (SELECT position, {mask_sql("content")} AS masked FROM {lines}) GROUP BY masked
), shapes AS (
  SELECT *, len(toks) AS n, CASE WHEN len(toks) <= 1 THEN '' WHEN regexp_matches(toks[1], '\p{{Nd}}') THEN '<*>' ELSE toks[1] END AS key FROM (
    SELECT *, CASE WHEN t = '' THEN [] ELSE regexp_split_to_array(t, '\s+') END AS toks FROM (SELECT *, regexp_replace(masked, '^\s+|\s+$', '', 'g') AS t FROM masked))
), firsts AS (
  SELECT n, key FROM (SELECT n, key, row_number() OVER (PARTITION BY n ORDER BY min(first_pos), key) AS r FROM shapes WHERE key <> '<*>' GROUP BY n, key) WHERE r < 100
), found_{digits + 1} AS (
  SELECT n, coalesce(f.key, '<*>') AS leaf, md5(array_to_string(toks, ' ')) AS part, toks, first_pos, lines FROM shapes LEFT JOIN firsts f USING (n, key)
)"""]
    for d in range(digits, -1, -1):
        ctes.append(f"""rows_{d} AS (
  SELECT n, leaf, substring(part, 1, {d}) AS part, toks, first_pos, lines,
    row_number() OVER (PARTITION BY n, leaf, substring(part, 1, {d}) ORDER BY first_pos) AS k FROM found_{d + 1}
), fold_{d} AS (
  SELECT n, leaf, part, k, [{{'toks': toks, 'first_pos': first_pos, 'lines': lines}}] AS found FROM rows_{d} WHERE k = 1
  UNION ALL
  SELECT n, leaf, part, k, CASE WHEN n > 0 AND same[best] < 0.4 * n THEN list_append(found, {{'toks': toks, 'first_pos': first_pos, 'lines': lines}})
    ELSE list_transform(found, lambda t, i: CASE WHEN i <> best THEN t ELSE
      {{'toks': list_transform(t.toks, lambda w, j: CASE WHEN w = toks[j] THEN w ELSE '<*>' END), 'first_pos': least(t.first_pos, first_pos), 'lines': t.lines + lines}} END) END
  FROM (
    SELECT *, list_position(ranks, list_max(ranks)) AS best FROM (
      SELECT *, list_transform(found, lambda t, i: same[i] * (n + 1) + len(list_filter(t.toks, lambda w: w = '<*>'))) AS ranks FROM (
        SELECT f.n, f.leaf, f.part, r.k, f.found, r.toks, r.first_pos, r.lines,
          list_transform(f.found, lambda t: len(list_filter(t.toks, lambda w, j: w <> '<*>' AND w = r.toks[j]))) AS same
        FROM fold_{d} f JOIN rows_{d} r ON r.n = f.n AND r.leaf = f.leaf AND r.part = f.part AND r.k = f.k + 1)))
), found_{d} AS (
  SELECT n, leaf, part, t.toks AS toks, t.first_pos AS first_pos, t.lines AS lines FROM (
    SELECT n, leaf, part, unnest(found) AS t FROM (SELECT *, max(k) OVER (PARTITION BY n, leaf, part) AS last FROM fold_{d}) WHERE k = last)
)""")
    ctes.append("mined AS (SELECT row_number() OVER (ORDER BY first_pos) AS template_id, n, toks, first_pos, lines FROM found_0)")
    return ",\n".join(ctes)


DIGITS = 2
DOCUMENT_LINES_SQL = """doc_lines AS (
  SELECT row_number() OVER (ORDER BY doc_id, i) AS position, content
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
  WHERE trim(content) <> ''
)"""


@query(
    "mine_document_templates",
    sql(
        DOCUMENT_LINES_SQL + ",\n" + mining_sql("doc_lines", DIGITS),
        "SELECT template_id, n AS n_tokens, lines, array_to_string(toks, ' ') AS template FROM mined",
    ),
)
def mine_document_templates(spark: SparkSession, sf: str) -> DataFrame:
    """Templates of all paragraphs of all documents: many shapes, in the order of appearance."""
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "content")).where("trim(content) <> ''")
    # Two integers in one, which need not be dense: numbering the lines would shuffle all their texts.
    first = F.coalesce("doc_id", F.lit(-(1 << 63))).cast("decimal(20,0)") * F.lit(1 << 32)
    lines = lines.select("content", (first + F.col("i")).cast("decimal(38,0)").alias("position"))
    mined = tpl.mine_templates(lines, digits=DIGITS, width=1 << 46, many=True)
    return mined.select("template_id", "n_tokens", "lines", tpl.template_text(F.col("tokens")).alias("template"))


# Service lines whose variable words no mask covers: only merging shapes gives their five templates.
SERVICE_LINES = {
    "click": ("session opened for ", " by operator on ", "user", "host"), "view": ("session closed for ", " after idle period in ", "user", "zone"),
    "purchase": ("transfer of item ", " was accepted from ", "item", "user"), "signup": ("transfer by new ", " held back at ", "user", "host"),
    "error": ("login ", " failed twice from ", "user", "host"),
}
_NAMES = {"user": (150, 1), "host": (12, 3), "zone": (9, 7), "item": (40, 5)}  # how many there are, and their step
_SERVICE_SQL = " ".join(
    f"WHEN '{k}' THEN '{a}' || '{x}' || (event_id * {_NAMES[x][1]} % {_NAMES[x][0]}) || 'x' || '{b}' || '{y}' || (event_id * {_NAMES[y][1]} % {_NAMES[y][0]}) || 'x'"
    for k, (a, b, x, y) in SERVICE_LINES.items()
)
SERVICE_SQL = f"""service AS (SELECT event_id + 1 AS position, event_type, CASE event_type {_SERVICE_SQL} END AS content FROM events),
words AS (SELECT position, event_type, unnest(string_split(content, ' ')) AS w, generate_subscripts(string_split(content, ' '), 1) AS j FROM service),
places AS (SELECT event_type, j, CASE WHEN count(DISTINCT w) = 1 THEN min(w) ELSE '<*>' END AS w, min(position) AS first_pos, count(*) AS lines FROM words GROUP BY event_type, j),
expected AS (
  SELECT event_type, string_agg(w, ' ' ORDER BY j) AS template, min(first_pos) AS first_pos, min(lines) AS lines, row_number() OVER (ORDER BY min(first_pos)) AS template_id
  FROM places GROUP BY event_type
)"""


def service_log(spark: SparkSession, sf: str) -> DataFrame:
    event = F.col("event_id")
    name = lambda kind: F.concat(F.lit(kind), (event * _NAMES[kind][1] % _NAMES[kind][0]).cast("string"), F.lit("x"))
    content = F
    for kind, (a, b, x, y) in SERVICE_LINES.items():
        content = content.when(F.col("event_type") == kind, F.concat(F.lit(a), name(x), F.lit(b), name(y)))
    return table(spark, sf, "events").select((event + 1).alias("position"), content.alias("content"))


@query("mine_service_templates", sql(SERVICE_SQL, "SELECT template_id, template, first_pos, lines FROM expected"))
def mine_service_templates(spark: SparkSession, sf: str) -> DataFrame:
    """Five templates from thousands of shapes, merged over parts of each leaf."""
    mined = tpl.mine_templates(service_log(spark, sf), digits=DIGITS)
    return mined.select("template_id", tpl.template_text(F.col("tokens")).alias("template"), "first_pos", "lines")


@query("service_template_match", sql(SERVICE_SQL, "SELECT position, template_id FROM service JOIN expected USING (event_type)"))
def service_template_match(spark: SparkSession, sf: str) -> DataFrame:
    """Every line meets its template, all of which hold wildcards."""
    lines = service_log(spark, sf)
    return tpl.match_templates(lines, tpl.mine_templates(lines, digits=DIGITS)).select("position", "template_id")


@query("template_match", sql(TEMPLATE_SQL, "SELECT position, template_id FROM log JOIN t USING (masked)"))
def template_match(spark: SparkSession, sf: str) -> DataFrame:
    lines = block_log(spark, sf).select("position", line_content(F.col("value")).alias("content"))
    return tpl.match_templates(lines, tpl.mine_templates(lines)).select("position", "template_id")


MATRIX_SQL = TEMPLATE_SQL + """,
cnt AS (SELECT block_id, template_id, count(*) AS n FROM bl JOIN t USING (masked) GROUP BY ALL),
voc AS (SELECT template_id, row_number() OVER (ORDER BY template_id) - 1 AS col FROM (SELECT DISTINCT template_id FROM cnt)),
vec AS (SELECT block_id, string_agg(col || ':' || n, ',' ORDER BY col) AS vec FROM cnt JOIN voc USING (template_id) GROUP BY block_id),
mat AS (SELECT block_id, vec, label FROM vec JOIN lab USING (block_id))"""


def matched_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """(position, blocks, template_id) of every line; the log is rendered, cut and masked once."""
    masked = cut_lineage(tpl.with_mask(blk.with_blocks(block_log(spark, sf))).select("position", "blocks", "masked"))
    shapes = cut_lineage(tpl.shapes_of(masked))
    return masked.join(tpl.match_masked(shapes, tpl.mine_shapes(shapes)), "masked").select("position", "blocks", "template_id")


def counts_and_vocab(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = matched_blocks(spark, sf).select("template_id", F.explode("blocks").alias("block_id"))
    counts = cut_lineage(blk.block_counts(rows))
    return counts, blk.vocabulary(counts)


def matrix(spark: SparkSession, sf: str) -> DataFrame:
    counts, vocab = counts_and_vocab(spark, sf)
    return blk.labelled(blk.to_vectors(counts, vocab), block_labels(spark, sf))


@query(
    "block_matrix",
    sql(
        MATRIX_SQL,
        """SELECT block_id, vec, label, features FROM mat JOIN (
             SELECT block_id, string_agg(coalesce(n, 0), ',' ORDER BY col) AS features
             FROM (SELECT DISTINCT block_id FROM cnt) b CROSS JOIN voc LEFT JOIN cnt USING (block_id, template_id) GROUP BY block_id) USING (block_id)""",
    ),
)
def block_matrix(spark: SparkSession, sf: str) -> DataFrame:
    cells = F.transform(vector_to_array("features"), lambda x: x.cast("long").cast("string"))
    return matrix(spark, sf).select(
        "block_id", blk.vector_key(F.col("entries")).alias("vec"), "label", F.array_join(cells, ",").alias("features")
    )


@query(
    "matrix_stats",
    sql(
        MATRIX_SQL,
        """SELECT (SELECT count(*) FROM log) AS lines_read, (SELECT count(*) FROM log WHERE len(blocks) > 0) AS lines_with_block_id,
           count(*) AS blocks, CAST(sum(label) AS BIGINT) AS anomalous_blocks, round(avg(label), 5) AS anomaly_rate,
           (SELECT count(*) FROM voc) AS templates FROM mat""",
    ),
)
def matrix_stats(spark: SparkSession, sf: str) -> DataFrame:
    counts, vocab = counts_and_vocab(spark, sf)
    labelled = counts.select("block_id").distinct().join(block_labels(spark, sf), "block_id")
    return blk.matrix_stats(blk.with_blocks(block_log(spark, sf)), labelled, vocab)


SPLIT_SQL = LOG_SQL + """,
strat AS (
  SELECT block_id, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY sha256('42|' || block_id))
    <= count(*) OVER (PARTITION BY label) // 2 THEN 'train' ELSE 'test' END AS side FROM lab
)"""


@query("stratified_split", sql(SPLIT_SQL, "SELECT * FROM strat"))
def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    return blk.stratified_split(block_labels(spark, sf))


ROLES_SQL = SPLIT_SQL + """,
roles AS (
  SELECT position, CASE WHEN bool_or(side = 'test') THEN 'held_out' ELSE 'train' END AS role,
    bool_or(side = 'test') AND bool_or(side = 'train') AS mixed, any_value(masked) AS masked
  FROM bl JOIN strat USING (block_id) GROUP BY position
)"""


def roles(spark: SparkSession, sf: str) -> DataFrame:
    return blk.line_roles(block_rows(spark, sf), blk.stratified_split(block_labels(spark, sf)))


@query("holdout_line_roles", sql(ROLES_SQL, "SELECT position, role, mixed FROM roles"))
def holdout_line_roles(spark: SparkSession, sf: str) -> DataFrame:
    return roles(spark, sf)


@query(
    "holdout_coverage",
    sql(
        ROLES_SQL,
        """SELECT count(*) FILTER (WHERE role = 'train') AS train_lines, count(*) FILTER (WHERE role = 'held_out') AS held_out_lines,
           count(*) FILTER (WHERE role = 'held_out' AND known) AS held_out_matched_lines,
           count(*) FILTER (WHERE role = 'held_out' AND NOT known) AS held_out_unmatched_lines,
           count(*) FILTER (WHERE mixed) AS mixed_split_lines
           FROM (SELECT *, masked IN (SELECT masked FROM roles WHERE role = 'train') AS known FROM roles)""",
    ),
)
def holdout_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Templates come from train lines only; held-out lines are matched against them."""
    lines = block_log(spark, sf).select("position", line_content(F.col("value")).alias("content"))
    tagged = lines.join(roles(spark, sf), "position")
    train_templates = tpl.mine_templates(tagged.where("role = 'train'"))
    matched = tpl.match_templates(tagged, train_templates)
    return blk.holdout_coverage(matched.withColumn("matched", F.col("template_id").isNotNull()))


TIME_SQL = LOG_SQL + """,
span AS (SELECT block_id, min(position) AS first_line, max(position) AS last_line FROM bl JOIN lab USING (block_id) GROUP BY block_id),
tsplit AS (
  SELECT *, CASE WHEN last_line <= c THEN 'train' WHEN first_line > c THEN 'test' ELSE 'excluded' END AS side
  FROM span, (SELECT count(*) // 2 AS c FROM log)
)"""


def time_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = block_rows(spark, sf).join(block_labels(spark, sf), "block_id")
    total = block_log(spark, sf).agg(F.count("*").alias("lines_read"))
    return blk.time_disjoint_split(blk.block_spans(rows), total)


@query("time_disjoint_split", sql(TIME_SQL, "SELECT block_id, first_line, last_line, side FROM tsplit"))
def time_disjoint_split(spark: SparkSession, sf: str) -> DataFrame:
    return time_split(spark, sf).select("block_id", "first_line", "last_line", "side")


OVERLAP_SQL = MATRIX_SQL + TIME_SQL[len(LOG_SQL):] + """,
g AS (
  SELECT vec, count(*) FILTER (WHERE side = 'train') AS tr, count(*) FILTER (WHERE side = 'test') AS te,
    count(*) FILTER (WHERE side = 'test' AND label = 1) AS pos, count(*) FILTER (WHERE side = 'test' AND label = 0) AS neg
  FROM mat JOIN tsplit USING (block_id) WHERE side <> 'excluded' GROUP BY vec
)"""


@query(
    "vector_overlap",
    sql(
        OVERLAP_SQL,
        """SELECT count(*) AS distinct_vectors, count(*) FILTER (WHERE tr > 0) AS train_distinct_vectors,
           count(*) FILTER (WHERE te > 0) AS test_distinct_vectors,
           CAST(coalesce(sum(te) FILTER (WHERE tr > 0), 0) AS BIGINT) AS test_rows_seen_in_train,
           CAST(coalesce(sum(pos) FILTER (WHERE tr > 0), 0) AS BIGINT) AS test_positive_seen_in_train,
           CAST(coalesce(sum(neg) FILTER (WHERE tr > 0), 0) AS BIGINT) AS test_negative_seen_in_train FROM g""",
    ),
)
def vector_overlap(spark: SparkSession, sf: str) -> DataFrame:
    vectors = matrix(spark, sf).select("block_id", blk.vector_key(F.col("entries")).alias("vec"), "label")
    sides = time_split(spark, sf).where("side <> 'excluded'").select("block_id", "side")
    return blk.vector_overlap(vectors.join(sides, "block_id"))


@query(
    "trainability",
    sql(
        SPLIT_SQL,
        """SELECT count(*) AS rows, count(DISTINCT label) AS classes, count(*) FILTER (WHERE side = 'train') AS train_rows,
           count(*) FILTER (WHERE side = 'test') AS test_rows, 'ok' AS reason, true AS trainable FROM strat""",
    ),
)
def trainability(spark: SparkSession, sf: str) -> DataFrame:
    return blk.check_trainable(blk.stratified_split(block_labels(spark, sf))).drop("train_classes")


@query(
    "out_of_order_lines",
    """SELECT line, stamp, previous_stamp FROM (
         SELECT *, lag(stamp) OVER (ORDER BY line) AS previous_stamp FROM (
           SELECT event_id + 1 AS line, strftime(CASE WHEN event_id % 500 = 77 THEN ts - INTERVAL 2 DAY ELSE ts END, '%y%m%d%H%M%S') AS stamp FROM events))
       WHERE stamp < previous_stamp""",
)
def out_of_order_lines(spark: SparkSession, sf: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    late = F.when(F.col("event_id") % 500 == 77, ts - F.expr("INTERVAL 2 DAYS")).otherwise(ts)
    lines = table(spark, sf, "events").select((F.col("event_id") + 1).alias("line"), F.date_format(late, "yyMMddHHmmss").alias("stamp"))
    return ordering.out_of_order(lines, "stamp", "line", width=1000).select("line", "stamp", "previous_stamp")


# --- live scoring ---------------------------------------------------------------------------------
# Two of the templates are unknown to the miner or to the model.
LIVE_SQL = TEMPLATE_SQL + """,
lt AS (SELECT log.*, template_id % 5 = 4 AS unmatched, template_id % 5 = 3 AS oov, template_id FROM log JOIN t USING (masked)),
lv AS (SELECT DISTINCT template_id FROM lt WHERE len(blocks) > 0 AND NOT unmatched AND NOT oov),
lc AS (SELECT template_id, row_number() OVER (ORDER BY template_id) - 1 AS col FROM lv),
lb AS (SELECT position, unnest(blocks) AS block_id, template_id FROM lt),
run AS (
  SELECT position, block_id, count(*) OVER w AS lines,
    -1.5 + coalesce(sum(0.25 * (col - 3)) OVER w, 0)::DOUBLE AS margin
  FROM lb LEFT JOIN lc USING (template_id) WINDOW w AS (PARTITION BY block_id ORDER BY position ROWS UNBOUNDED PRECEDING)
),
live AS (SELECT position, block_id, lines, round(1 / (1 + exp(-margin)), 4) AS probability FROM run)"""


def live_lines(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(lines with model columns, vocabulary)."""
    lines = cut_lineage(tpl.with_mask(blk.with_blocks(block_log(spark, sf))).select("position", "blocks", "masked"))
    shapes = cut_lineage(tpl.shapes_of(lines))
    known = tpl.match_masked(shapes, tpl.mine_shapes(shapes).where("template_id % 5 <> 4"))
    named = lines.where(F.size("blocks") > 0).select("masked").distinct()
    vocab = stored(blk.vocabulary(known.join(named, "masked").where("template_id % 5 <> 3")))
    # shapes meet their columns before they meet the lines
    return lines.join(stored(blk.with_model_column(known, vocab)), "masked"), vocab


def live_scores(spark: SparkSession, sf: str) -> DataFrame:
    """A model whose weights follow a rule over the whole vocabulary, so that SQL can score it too."""
    lines, vocab = live_lines(spark, sf)
    rows = lines.select("position", "column", F.explode("blocks").alias("block_id"))
    return blk.partial_block_scores(rows, -1.5, vocab.select("column", (0.25 * (F.col("column") - 3)).alias("weight")))


@query("partial_block_scores", sql(LIVE_SQL, "SELECT position, block_id, lines, probability FROM live"))
def partial_block_scores(spark: SparkSession, sf: str) -> DataFrame:
    return live_scores(spark, sf).select("position", "block_id", "lines", "probability")


@query(
    "probability_spread",
    sql(
        LIVE_SQL,
        """SELECT count(*) AS samples, min(probability) AS min_probability, round(quantile_cont(probability, 0.5), 4) AS median_probability,
           max(probability) AS max_probability FROM (SELECT * FROM live ORDER BY position DESC, block_id LIMIT 200)""",
    ),
)
def probability_spread(spark: SparkSession, sf: str) -> DataFrame:
    return blk.probability_spread(live_scores(spark, sf), 200, [F.desc("position"), F.col("block_id")])


@query(
    "scorer_drift",
    sql(
        LIVE_SQL,
        """SELECT count(*) AS lines_seen, count(*) FILTER (WHERE len(blocks) > 0 AND unmatched) AS unmatched_lines,
           count(*) FILTER (WHERE len(blocks) > 0 AND oov) AS out_of_vocabulary_lines,
           least(300, (SELECT count(DISTINCT block_id) FROM lb)) AS blocks_tracked,
           greatest(0, (SELECT count(DISTINCT block_id) FROM lb) - 300) AS blocks_beyond_limit FROM lt""",
    ),
)
def scorer_drift(spark: SparkSession, sf: str) -> DataFrame:
    return blk.scorer_drift(live_lines(spark, sf)[0], 300)


@query(
    "block_recency_topk",
    sql(LOG_SQL, "SELECT block_id, max(position) AS last_line FROM bl GROUP BY block_id ORDER BY last_line DESC, block_id LIMIT 300"),
)
def block_recency_topk(spark: SparkSession, sf: str) -> DataFrame:
    return blk.block_recency_topk(block_rows(spark, sf), 300)


# --- classifiers ----------------------------------------------------------------------------------
# A block is anomalous if a client deleted it: what its counts can tell, by one template or the one with two blocks.
TAUGHT_SQL = LOG_SQL + """,
taught AS (SELECT block_id, CASE WHEN count(*) FILTER (content LIKE 'client:Deleting block %') > 0 THEN 1 ELSE 0 END AS label FROM bl GROUP BY block_id),
halves AS (
  SELECT block_id, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY sha256('42|' || block_id))
    <= count(*) OVER (PARTITION BY label) // 2 THEN 'train' ELSE 'test' END AS side FROM taught
)"""
# A classifier that has learnt the rule makes no mistake on the other half.
LEARNT_SQL = sql(
    TAUGHT_SQL,
    """SELECT count(*) AS rows, count(*) FILTER (label = 1) AS tp, 0::BIGINT AS fp, 0::BIGINT AS fn, count(*) FILTER (label = 0) AS tn,
       1.0::DOUBLE AS precision, 1.0::DOUBLE AS recall, 1.0::DOUBLE AS f1, 0.0::DOUBLE AS false_positive_rate FROM halves WHERE side = 'test'""",
)


def taught_labels(spark: SparkSession, sf: str) -> DataFrame:
    deleted = F.count_if(F.col("content").startswith("client:Deleting block "))
    return block_rows(spark, sf).groupBy("block_id").agg((deleted > 0).cast("int").alias("label"))


def _halves(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    counts, vocab = counts_and_vocab(spark, sf)
    sides = blk.stratified_split(taught_labels(spark, sf))
    # Both halves, and every iteration of a fit, read the written matrix instead of the log.
    rows = cut_lineage(blk.labelled(blk.to_vectors(counts, vocab), sides))
    return rows.where("side = 'train'"), rows.where("side = 'test'")


@query("fit_logistic")
def fit_logistic(spark: SparkSession, sf: str) -> DataFrame:
    train, test = _halves(spark, sf)
    return metrics.confusion(models.predict(models.fit_logistic(train), test), "label", "predicted", undefined="zero")


@query("fit_tree", LEARNT_SQL)
def fit_tree(spark: SparkSession, sf: str) -> DataFrame:
    train, test = _halves(spark, sf)
    return metrics.confusion(models.predict(models.fit_tree(train), test), "label", "predicted", undefined="zero")


@query("fit_isolation")
def fit_isolation(spark: SparkSession, sf: str) -> DataFrame:
    train, test = _halves(spark, sf)
    scored = blk.score_isolation(test, blk.fit_isolation(train))
    return metrics.confusion(scored, "label", "isolation_anomaly", undefined="zero")
