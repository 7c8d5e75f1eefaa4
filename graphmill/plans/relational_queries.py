"""Joins, windows and scalar functions of the engine over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphmill.functions import flags, names, spans
from graphmill.operators.rollup import first_match
from graphmill.plans.tables import table


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line, start, stop, body): the lines of every text with byte offsets."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "body"))
    order = Window.partitionBy("doc_id").orderBy("at")  # the lines of one text
    size = F.octet_length("body").cast("bigint")
    start = F.sum(size + 1).over(order) - size - 1
    return docs.select("doc_id", (F.col("at") + 1).cast("bigint").alias("line"), start.alias("start"), (start + size).alias("stop"), "body")


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, start, word) of the words of every text, by byte offset; words are cut at single spaces and line ends."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "[ \n]")).alias("at", "word"))
    order = Window.partitionBy("doc_id").orderBy("at")
    size = F.octet_length("word").cast("bigint")
    return docs.withColumn("start", F.sum(size + 1).over(order) - size - 1).where("word <> ''").select("doc_id", "start", "word")


def asof_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line and byte column of the first capitalised word's end, every tenth of its text, as-of the greatest line start.

    One sort per text carries the latest line start forward; no range join.
    """
    docs = table(spark, sf_dir, "documents")
    size = F.octet_length("text").cast("bigint")
    points = docs.where(size > 0).select("doc_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.floor(size * i / 10))).alias("offset")).distinct()
    starts = _lines(spark, sf_dir).select("doc_id", F.col("start").alias("offset"), "line", F.col("start").alias("_start"))
    both = starts.withColumn("_point", F.lit(0)).unionByName(points.select("doc_id", "offset", F.lit(None).cast("bigint").alias("line"), F.lit(None).cast("bigint").alias("_start"), F.lit(1).alias("_point")))
    before = Window.partitionBy("doc_id").orderBy("offset", "_point").rowsBetween(Window.unboundedPreceding, 0)
    known = both.select("doc_id", "offset", "_point", F.last("line", ignorenulls=True).over(before).alias("line"), F.last("_start", ignorenulls=True).over(before).alias("_start"))
    return known.where("_point = 1").select("doc_id", "offset", "line", (F.col("offset") - F.col("_start") + 1).alias("col"))


def line_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every text with its byte span."""
    return _lines(spark, sf_dir).select("doc_id", "line", "start", "stop")


def band_join_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words per line: word positions within line spans of the same text. One sort per text carries the last line forward; no range join."""
    words = _words(spark, sf_dir).select("doc_id", F.col("start").alias("at"), F.lit(None).cast("bigint").alias("line"), F.lit(None).cast("bigint").alias("stop"))
    lines = _lines(spark, sf_dir).where("stop > start").select("doc_id", F.col("start").alias("at"), "line", "stop")  # an empty line has no words
    before = Window.partitionBy("doc_id").orderBy("at", F.col("line").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    known = lines.unionByName(words).select("doc_id", "at", F.col("line").isNull().alias("_word"), F.last("line", ignorenulls=True).over(before).alias("line"), F.last("stop", ignorenulls=True).over(before).alias("stop"))
    return known.where("_word and at < stop").groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("n_words"))


def positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The n-th user turn beside the n-th assistant turn of a conversation (captures beside inputs, arguments beside parameters)."""
    turns = table(spark, sf_dir, "conversations")
    place = Window.partitionBy("conv_id", "role").orderBy("turn")
    numbered = turns.where("role in ('user', 'assistant')").select("conv_id", "role", "turn", F.row_number().over(place).cast("bigint").alias("place"))
    user = numbered.where("role = 'user'").select("conv_id", "place", F.col("turn").alias("user_turn"))
    reply = numbered.where("role = 'assistant'").select("conv_id", "place", F.col("turn").alias("assistant_turn"))
    return user.join(reply, ["conv_id", "place"])


def first_match_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order and return flag the first line: R before others, then by line, quantity and part (first match in order)."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_suppkey")
    best = first_match(lines, ["l_orderkey"], [F.desc(F.col("l_returnflag") == "R"), "l_linenumber", "l_partkey", "l_quantity", "l_suppkey", "l_extendedprice"])
    return best.select("l_orderkey", "l_returnflag", "l_linenumber", "l_partkey")


def candidate_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several candidates for one name: the first, in supplier order, of a balance above zero; none is NULL."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("name_key"), "n_name")
    candidates = table(spark, sf_dir, "supplier").where("s_acctbal > 0").groupBy(F.col("s_nationkey").alias("_k")).agg(F.min("s_suppkey").alias("candidate"))
    return nations.join(candidates, F.col("name_key") == F.col("_k"), "left").select("name_key", "n_name", "candidate")


def _hrefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("ord", "specifier")
    return pages.select("page_id", found).withColumn("ord", F.col("ord").cast("bigint"))


def import_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links as imports: kind by the dot rule, then why a link does not resolve (external, unknown_module, not_a_source_file, load_failed) or ``resolved``."""
    links = _hrefs(spark, sf_dir).withColumn("kind", names.import_kind_of(F.col("specifier")))
    known = table(spark, sf_dir, "pages").select(F.col("url").alias("_url")).distinct()
    joined = links.join(known, F.col("specifier") == F.col("_url"), "left")
    reason = (
        F.when(F.col("_url").isNotNull(), "resolved")
        .when((F.col("kind") == "module") & F.col("specifier").startswith("http"), "external")
        .when(F.col("kind") == "module", "unknown_module")
        .when(~F.col("specifier").endswith(".html"), "not_a_source_file")
        .otherwise("load_failed")
    )
    return joined.select("page_id", "ord", "specifier", "kind", reason.alias("reason"))


def external_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct link targets, by their first path component, in the order in which pages first name them."""
    targets = _hrefs(spark, sf_dir).withColumn("target", F.regexp_extract("specifier", "^(?:[a-z]+:/)?/?([^/]+)", 1)).where("target <> ''")
    first = targets.groupBy("target").agg(F.min(F.struct("page_id", "ord")).alias("_first"), F.count(F.lit(1)).alias("n"))
    return first.select("target", F.col("_first.page_id").alias("first_page"), F.col("_first.ord").alias("first_ord"), "n")


def ident_primitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that spell a primitive type or value, beside the rule for sized integers, per kind."""
    made = table(spark, sf_dir, "orders").select(F.explode(F.array(
        F.concat(F.lit("u"), (F.col("o_orderkey") % 40).cast("string")), F.concat(F.lit("i"), (F.col("o_custkey") % 200).cast("string")),
        F.lower(F.substring("o_orderpriority", 3, 20)), F.lit("usize"), F.lit("undefined"))).alias("name"))
    words = _words(spark, sf_dir).select(F.lower("word").alias("name"))
    every = made.unionByName(words)
    kind = F.when(names.is_primitive_type(F.col("name")), "type").when(names.is_primitive_value(F.col("name")), "value").otherwise("none")
    return every.select("name", kind.alias("kind")).where("kind <> 'none'").groupBy("name", "kind").agg(F.count(F.lit(1)).alias("n"))


def span_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length, containment, shifts and equality of spans made of order lines."""
    line = table(spark, sf_dir, "lineitem")
    s = spans.sized(F.col("l_partkey"), F.col("l_linenumber").cast("bigint"))
    moved = spans.shift_left(spans.shift_right(s, F.col("l_suppkey")), F.lit(1).cast("bigint"))
    rows = line.select("l_orderkey", s.alias("s"), moved.alias("m"), F.col("l_suppkey"))
    return rows.groupBy("l_orderkey").agg(
        F.sum(spans.length(F.col("s"))).alias("total"), F.count_if(spans.contains(F.col("s"), F.col("l_suppkey"))).alias("n_contains"),
        F.max(F.col("m.start")).alias("last_start"), F.count_if(spans.same(F.col("s"), F.col("m"))).alias("n_same"),
    )


def flag_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bit-set operations on 14-bit sets made of part keys and sizes."""
    part = table(spark, sf_dir, "part")
    a, b = (F.col("p_partkey") % 16384).cast("bigint"), F.col("p_size").cast("bigint")
    return part.select(
        "p_partkey", flags.merge(a, b).alias("merged"), flags.intersects(a, b).alias("meets"), flags.contains(a, b).alias("holds"), flags.is_empty(a).alias("is_empty"),
        flags.invert(a, 14).alias("inverted"), flags.assign(a, b, F.lit(False)).alias("cleared"), flags.assign(a, b, F.lit(True)).alias("filled"),
        F.concat_ws("+", flags.names_of(a, flags.SYMBOL_FLAGS)).alias("names"), flags.member_use(a, "call").alias("member_call"), flags.self_use(a, "call").alias("self_call"),
    )


def json_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags and places as JSON: reference flags from the part's size, a place from its key and size."""
    part = table(spark, sf_dir, "part")
    place = spans.location(F.col("p_partkey"), F.col("p_size"), F.col("p_name"))
    return part.select("p_partkey", flags.to_json(F.col("p_size") % 64, flags.REFERENCE_FLAGS).alias("uses"), spans.location_json(place).alias("place"))


def excluded_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages below an excluded directory (a prefix, then a separator): the first three path levels of the lowest page of each host."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    host = F.substring_index("path", "/", 1)
    least = pages.groupBy(host.alias("host")).agg(F.min("path").alias("least"))
    excluded = least.select("host", F.substring_index("least", "/", 2).alias("directory"))
    kept = pages.withColumn("host", host).join(excluded, "host")
    return kept.select("page_id", "path", names.under(F.col("path"), F.col("directory")).alias("excluded"))


_WORDS = """words AS (
  SELECT doc_id, word, sum(strlen(word) + 1) OVER (PARTITION BY doc_id ORDER BY at_) - strlen(word) - 1 AS start
  FROM (SELECT doc_id, unnest(string_split_regex(text, '[ \\n]')) AS word, generate_subscripts(string_split_regex(text, '[ \\n]'), 1) AS at_ FROM documents))"""
_LINES = """lines AS (
  SELECT doc_id, at_ AS line, CAST(sum(strlen(body) + 1) OVER (PARTITION BY doc_id ORDER BY at_) - strlen(body) - 1 AS BIGINT) AS start, strlen(body) AS size
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) AS at_ FROM documents))"""
_HREFS = """hrefs AS (
  SELECT page_id, unnest(l) AS specifier, generate_subscripts(l, 1) - 1 AS ord
  FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS l FROM pages))"""
_TYPES = ", ".join(f"'{n}'" for n in names.PRIMITIVE_TYPES)
_VALUES = ", ".join(f"'{n}'" for n in names.PRIMITIVE_VALUES)
_NAMES = " || ".join(f"CASE WHEN a & {1 << i} <> 0 THEN '{n}+' ELSE '' END" for i, n in enumerate(flags.SYMBOL_FLAGS))

QUERIES = {
    f.__name__: f
    for f in (asof_line, line_index, band_join_tokens, positional_zip, first_match_export, candidate_first, import_reason, external_first_seen, ident_primitive, span_algebra, flag_algebra, json_forms, excluded_paths)
}
ORACLES = {
    "asof_line": f"""WITH {_LINES},
points AS (SELECT DISTINCT doc_id, CAST(floor(strlen(text) * i / 10) AS BIGINT) AS "offset" FROM documents, range(10) r(i) WHERE strlen(text) > 0)
SELECT p.doc_id, p."offset", l.line, p."offset" - l.start + 1 AS col FROM points p ASOF JOIN lines l ON p.doc_id = l.doc_id AND p."offset" >= l.start""",
    "line_index": f"WITH {_LINES} SELECT doc_id, line, start, start + size AS stop FROM lines",
    "band_join_tokens": f"WITH {_LINES}, {_WORDS} SELECT l.doc_id, l.line, count(*) AS n_words FROM words w JOIN lines l ON w.doc_id = l.doc_id AND w.start >= l.start AND w.start < l.start + l.size WHERE w.word <> '' GROUP BY l.doc_id, l.line",
    "positional_zip": """WITH n AS (SELECT conv_id, role, turn, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS place FROM conversations)
SELECT u.conv_id, u.place, u.turn AS user_turn, a.turn AS assistant_turn FROM n u JOIN n a ON u.conv_id = a.conv_id AND u.place = a.place WHERE u.role = 'user' AND a.role = 'assistant'""",
    "first_match_export": """SELECT l_orderkey, l_returnflag, l_linenumber, l_partkey FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_returnflag = 'R') DESC, l_linenumber, l_partkey, l_quantity, l_suppkey, l_extendedprice) = 1""",
    "candidate_first": "SELECT n_nationkey AS name_key, n_name, (SELECT min(s_suppkey) FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 0) AS candidate FROM nation",
    "import_reason": f"""WITH {_HREFS}, k AS (
  SELECT *, CASE WHEN regexp_matches(specifier, '^.+\\.[^.]+$') THEN 'file' ELSE 'module' END AS kind, specifier IN (SELECT url FROM pages) AS known FROM hrefs)
SELECT page_id, ord, specifier, kind, CASE WHEN known THEN 'resolved' WHEN kind = 'module' AND starts_with(specifier, 'http') THEN 'external' WHEN kind = 'module' THEN 'unknown_module'
  WHEN NOT suffix(specifier, '.html') THEN 'not_a_source_file' ELSE 'load_failed' END AS reason FROM k""",
    "external_first_seen": f"WITH {_HREFS}, h AS (SELECT *, regexp_extract(specifier, '^(?:[a-z]+:/)?/?([^/]+)', 1) AS target FROM hrefs) SELECT target, min(struct_pack(page_id, ord)).page_id AS first_page, min(struct_pack(page_id, ord)).ord AS first_ord, count(*) AS n FROM h WHERE target <> '' GROUP BY target",
    "ident_primitive": f"""WITH {_WORDS}, every AS (
  SELECT unnest(['u' || o_orderkey % 40, 'i' || o_custkey % 200, lower(substr(o_orderpriority, 3, 20)), 'usize', 'undefined']) AS name FROM orders
  UNION ALL SELECT lower(word) FROM words WHERE word <> ''),
kinds AS (SELECT name, CASE WHEN name IN ({_TYPES}) OR (strlen(name) > 2 AND regexp_full_match(name, '[iu][0-9]+')) THEN 'type' WHEN name IN ({_VALUES}) THEN 'value' ELSE 'none' END AS kind FROM every)
SELECT name, kind, count(*) AS n FROM kinds WHERE kind <> 'none' GROUP BY name, kind""",
    "span_algebra": """SELECT l_orderkey, CAST(sum(l_linenumber) AS BIGINT) AS total, count(*) FILTER (WHERE l_suppkey >= l_partkey AND l_suppkey < l_partkey + l_linenumber) AS n_contains,
  max(l_partkey + l_suppkey - 1) AS last_start, count(*) FILTER (WHERE l_suppkey = 1) AS n_same FROM lineitem GROUP BY l_orderkey""",
    "flag_algebra": f"""WITH s AS (SELECT p_partkey, CAST(p_partkey % 16384 AS BIGINT) AS a, CAST(p_size AS BIGINT) AS b FROM part)
SELECT p_partkey, a | b AS merged, a & b <> 0 AS meets, a & b = b AS holds, a = 0 AS is_empty, xor(a, 16383) AS inverted, a & ~b AS cleared, a | b AS filled,
  rtrim({_NAMES}, '+') AS names, a & 20 = 20 AS member_call, a & 4 <> 0 AND a & 16 = 0 AS self_call FROM s""",
    "json_forms": """SELECT p_partkey, '[' || array_to_string(list_filter([
  CASE WHEN p_size % 64 & 1 <> 0 THEN '"read"' END, CASE WHEN p_size % 64 & 2 <> 0 THEN '"write"' END, CASE WHEN p_size % 64 & 4 <> 0 THEN '"call"' END,
  CASE WHEN p_size % 64 & 8 <> 0 THEN '"type"' END, CASE WHEN p_size % 64 & 16 <> 0 THEN '"member"' END, CASE WHEN p_size % 64 & 32 <> 0 THEN '"primitive"' END], lambda x: x IS NOT NULL), ',') || ']' AS uses,
  '{"line":' || p_partkey || ',"column":' || p_size || '}' AS place FROM part""",
    "excluded_paths": """WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages),
h AS (SELECT *, split_part(path, '/', 1) AS host FROM p),
d AS (SELECT host, array_to_string(string_split(min(path), '/')[1:2], '/') AS directory FROM h GROUP BY host)
SELECT page_id, path, starts_with(path, directory || '/') AS excluded FROM h JOIN d USING (host)""",
}
