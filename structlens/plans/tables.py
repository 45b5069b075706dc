"""Inputs of the catalogue, derived from the benchmark tables, in Spark and as SQL with the same columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import spread
from ..sources.files import explode_lines


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- texts as files -------------------------------------------------------------------------------------------------


def doc_files(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents")).select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_path"), F.coalesce("text", F.lit("")).alias("source"))


def doc_lines(spark: SparkSession, d: str) -> DataFrame:
    return explode_lines(doc_files(spark, d))


def page_files(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "pages")).select(F.concat(F.lit("page/"), F.col("page_id").cast("string"), F.lit(".html")).alias("file_path"), F.regexp_replace(F.coalesce("html", F.lit("")), ">", ">\n").alias("source"))


def page_lines(spark: SparkSession, d: str) -> DataFrame:
    return explode_lines(page_files(spark, d))


def talk_files(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return c.select(F.concat(F.lit("talk/"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"), F.lit(".txt")).alias("file_path"), F.coalesce("text", F.lit("")).alias("source"))


def _lines_sql(name: str, key: str, text: str, source: str) -> str:
    return f"""
{name}_files AS (SELECT {key} AS file_path, {text} AS source FROM {source}),
{name}_parts AS (SELECT file_path, string_split(source, chr(10)) AS p FROM {name}_files),
{name}_whole AS (SELECT file_path, CASE WHEN p[-1] = '' THEN p[1:len(p) - 1] ELSE p END AS p FROM {name}_parts),
{name}_lines AS (SELECT file_path, CAST(i - 1 AS INTEGER) AS line_no, regexp_replace(p[i], chr(13) || '$', '') AS text
  FROM (SELECT file_path, p, unnest(range(1, len(p) + 1)) AS i FROM {name}_whole))"""


DOC = _lines_sql("doc", "'doc/' || doc_id || '.txt'", "coalesce(text, '')", "documents")
PAGE = _lines_sql("page", "'page/' || page_id || '.html'", "regexp_replace(coalesce(html, ''), '>', '>' || chr(10), 'g')", "pages")
TALK = _lines_sql("talk", "'talk/' || conv_id || '/' || turn || '.txt'", "coalesce(text, '')", "conversations")

# --- paths ----------------------------------------------------------------------------------------------------------

_EXTS = ["rs", "py", "ts", "go", "java", "md", "toml", "txt", "yml", "x"]
_TOPS = ["src", "lib", "docs", "tests", "config", "main.rs"]
_NAMES = ["lib", "index", "app", "main", "README", "Makefile", "widget_test", "spec_helper", "tests/mod", "Cargo"]


def paths(spark: SparkSession, d: str) -> DataFrame:
    """part_id, path: made-up paths of a repository."""
    k = F.col("p_partkey")
    pick = lambda names, step: F.element_at(F.array(*[F.lit(n) for n in names]), (F.floor(k / step) % len(names) + 1).cast("int"))
    name = F.concat(pick(_NAMES, 1), F.when(k % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("."), pick(_EXTS, 3))))
    return table(spark, d, "part").select(k.alias("part_id"), F.concat(pick(_TOPS, 10), F.lit("/m"), (k % 13).cast("string"), F.lit("/"), name).alias("path"))


def _pick_sql(names: list[str], step: int) -> str:
    return f"(['{chr(39) + ', ' + chr(39)}'])".replace(f"{chr(39)}, {chr(39)}", "', '".join(names)) + f"[CAST(floor(p_partkey / {step}) AS BIGINT) % {len(names)} + 1]"


PATHS = f"""
paths AS (SELECT p_partkey AS part_id, {_pick_sql(_TOPS, 10)} || '/m' || (p_partkey % 13) || '/' || {_pick_sql(_NAMES, 1)} ||
  CASE WHEN p_partkey % 7 = 0 THEN '' ELSE '.' || {_pick_sql(_EXTS, 3)} END AS path FROM part)"""

# --- a forest of symbols: nations are files, segments modules, customers classes, orders methods ----------------------


def symbols(spark: SparkSession, d: str) -> DataFrame:
    """The forest in the canonical schema; members of a parent lie inside its lines."""
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_name")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    o = o.join(c, o["o_custkey"] == c["c_custkey"])
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("string")
    segment = c.select("c_nationkey", "c_mktsegment").distinct().select("c_nationkey", "c_mktsegment", zero.alias("cust"), zero.alias("ord"), F.lower("c_mktsegment").alias("name"), F.lit(0).alias("depth"), F.lit("Module").alias("kind"), none.alias("signature"), none.alias("doc_comment"))
    cust_name = F.replace("c_name", F.lit("#"), F.lit("_"))
    odd = lambda k, a, b: F.when(F.col(k) % 2 == 1, a).otherwise(b)
    classes = c.select("c_nationkey", "c_mktsegment", (F.col("c_custkey") + 1).alias("cust"), zero.alias("ord"), cust_name.alias("name"), F.lit(1).alias("depth"), F.when(F.col("c_custkey") % 3 == 0, "Struct").otherwise("Class").alias("kind"), F.concat(odd("c_custkey", F.lit("pub struct "), F.lit("class ")), cust_name).alias("signature"), F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("A customer of "), F.lower("c_mktsegment"), F.lit("\nand more"))).alias("doc_comment"))
    word = F.lower(F.regexp_replace(F.substring("o_orderpriority", 3, 30), "[^A-Za-z]", "_"))
    order_name = F.concat(F.when(F.col("o_orderkey") % 11 == 0, F.lit("test_")).otherwise(F.lit("")), word, (F.col("o_orderkey") % 5).cast("string"))
    methods = o.select("c_nationkey", "c_mktsegment", (F.col("c_custkey") + 1).alias("cust"), (F.col("o_orderkey") + 1).alias("ord"), order_name.alias("name"), F.lit(2).alias("depth"), F.when(F.col("o_orderkey") % 17 == 0, "Import").otherwise("Method").alias("kind"), F.when(F.col("o_orderkey") % 6 != 0, F.concat(odd("o_orderkey", F.lit("pub async fn "), F.lit("fn ")), order_name, F.lit("(&self, key: Map<u64, str>, n: u32)"))).alias("signature"), none.alias("doc_comment"))
    rows = segment.unionByName(classes).unionByName(methods)
    file = W.partitionBy("c_nationkey").orderBy("c_mktsegment", "cust", "ord")
    seg, cus = W.partitionBy("c_nationkey", "c_mktsegment"), W.partitionBy("c_nationkey", "c_mktsegment", "cust")
    rows = rows.withColumn("seq", (F.row_number().over(file) - 1).cast("int"))
    first_seg, first_cus = F.min("seq").over(seg), F.min("seq").over(cus)
    rows = rows.withColumns({"n_seg": F.count(F.lit(1)).over(seg), "n_cus": F.count(F.lit(1)).over(cus), "p0": first_seg, "p1": first_cus})
    ext = F.element_at(F.array(*[F.lit(x) for x in ("rs", "py", "ts", "go", "java")]), (F.col("c_nationkey") % 5 + 1).cast("int"))
    path = F.concat(F.lit("nation/"), F.col("c_nationkey").cast("string"), F.lit("."), ext)
    owner = F.replace(F.format_string("Customer#%09d", F.col("cust") - 1), F.lit("#"), F.lit("_"))
    scope = F.when(F.col("depth") == 0, F.array().cast("array<string>")).when(F.col("depth") == 1, F.array(F.lower("c_mktsegment"))).otherwise(F.array(F.lower("c_mktsegment"), owner))
    end = F.col("seq") + F.when(F.col("depth") == 0, F.col("n_seg") - 1).when(F.col("depth") == 1, F.col("n_cus") - 1).otherwise(0)
    qualified = F.array_join(F.concat(scope, F.array("name")), "::")
    return rows.select(
        path.alias("file_path"), "seq", F.when(F.col("depth") == 1, F.col("p0")).when(F.col("depth") == 2, F.col("p1")).alias("parent_seq"), "depth", "name", "kind",
        F.col("seq").alias("line_start"), end.cast("int").alias("line_end"), (F.col("depth") * 4).alias("column_start"), scope.alias("scope_path"), qualified.alias("qualified_name"),
        F.concat(path, F.lit("::"), qualified, F.lit("@"), F.col("seq").cast("string"), F.lit(":"), (F.col("depth") * 4).cast("string")).alias("stable_id"), "signature", "doc_comment",
    )


SYMBOLS = """
sym_o AS (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey),
sym_n AS (SELECT *, CASE WHEN o_orderkey % 11 = 0 THEN 'test_' ELSE '' END || lower(regexp_replace(substring(o_orderpriority, 3, 30), '[^A-Za-z]', '_', 'g')) || (o_orderkey % 5) AS oname FROM sym_o),
sym_rows AS (
  SELECT DISTINCT c_nationkey, c_mktsegment, 0 AS cust, 0 AS ord, lower(c_mktsegment) AS name, 0 AS depth, 'Module' AS kind, NULL::VARCHAR AS signature, NULL::VARCHAR AS doc_comment FROM customer
  UNION ALL SELECT c_nationkey, c_mktsegment, c_custkey + 1, 0, replace(c_name, '#', '_'), 1, CASE WHEN c_custkey % 3 = 0 THEN 'Struct' ELSE 'Class' END,
    CASE WHEN c_custkey % 2 = 1 THEN 'pub struct ' ELSE 'class ' END || replace(c_name, '#', '_'),
    CASE WHEN c_custkey % 4 = 0 THEN 'A customer of ' || lower(c_mktsegment) || chr(10) || 'and more' END FROM customer
  UNION ALL SELECT c_nationkey, c_mktsegment, c_custkey + 1, o_orderkey + 1, oname, 2, CASE WHEN o_orderkey % 17 = 0 THEN 'Import' ELSE 'Method' END,
    CASE WHEN o_orderkey % 6 <> 0 THEN CASE WHEN o_orderkey % 2 = 1 THEN 'pub async fn ' ELSE 'fn ' END || oname || '(&self, key: Map<u64, str>, n: u32)' END, NULL FROM sym_n),
sym_seq AS (SELECT *, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment, cust, ord) - 1 AS INTEGER) AS seq FROM sym_rows),
sym_w AS (SELECT *, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS n_seg, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment, cust) AS n_cus,
  min(seq) OVER (PARTITION BY c_nationkey, c_mktsegment) AS p0, min(seq) OVER (PARTITION BY c_nationkey, c_mktsegment, cust) AS p1,
  'nation/' || c_nationkey || '.' || (['rs', 'py', 'ts', 'go', 'java'])[c_nationkey % 5 + 1] AS file_path FROM sym_seq),
sym_q AS (SELECT *, CASE depth WHEN 0 THEN name WHEN 1 THEN lower(c_mktsegment) || '::' || name ELSE lower(c_mktsegment) || '::' || printf('Customer_%09d', cust - 1) || '::' || name END AS qualified_name FROM sym_w),
symbols AS (SELECT file_path, seq, CASE depth WHEN 1 THEN p0 WHEN 2 THEN p1 END AS parent_seq, depth, name, kind, seq AS line_start,
  CAST(seq + CASE depth WHEN 0 THEN n_seg - 1 WHEN 1 THEN n_cus - 1 ELSE 0 END AS INTEGER) AS line_end, depth * 4 AS column_start, qualified_name,
  file_path || '::' || qualified_name || '@' || seq || ':' || (depth * 4) AS stable_id, signature, doc_comment FROM sym_q)"""


def positions(spark: SparkSession, d: str) -> DataFrame:
    """file_path, line: every line of every file, and one behind its end."""
    lines = symbols(spark, d).select("file_path", F.col("seq").alias("line"))
    return lines.unionByName(lines.groupBy("file_path").agg((F.max("line") + 7).alias("line")))


POSITIONS = "positions AS (SELECT file_path, seq AS line FROM symbols UNION ALL SELECT file_path, max(seq) + 7 FROM symbols GROUP BY file_path)"

# --- functions and the lines of their calls: orders are functions, their items are lines ------------------------------


def call_lines(spark: SparkSession, d: str) -> DataFrame:
    """file_path, line_no, o (the order), text."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    path = F.concat(F.lit("lib/"), F.floor(F.col("l_orderkey") / 50).cast("string"), F.lit(".rs"))
    body = F.concat(F.when(F.col("l_linenumber") % 3 == 0, F.lit("if x && y { ")).otherwise(F.lit("x = ")), F.lit("p_"), (F.col("l_partkey") % 40).cast("string"), F.lit("("), F.col("l_quantity").cast("int").cast("string"), F.lit(")"))
    at = F.row_number().over(W.partitionBy("file_path").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")) - 1
    return li.select(path.alias("file_path"), "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", body.alias("text")).withColumn("line_no", at.cast("int")).select("file_path", "line_no", F.col("l_orderkey").alias("o"), "text")


def call_functions(spark: SparkSession, d: str) -> DataFrame:
    rows = call_lines(spark, d).groupBy("file_path", "o").agg(F.min("line_no").alias("line_start"), F.max("line_no").alias("line_end"))
    return rows.select("file_path", F.col("o").alias("seq"), F.concat(F.lit("p_"), (F.col("o") % 40).cast("string")).alias("name"), F.lit("Function").alias("kind"), "line_start", "line_end")


CALLS = """
call_lines AS (SELECT 'lib/' || CAST(floor(l_orderkey / 50) AS BIGINT) || '.rs' AS file_path, l_orderkey AS o,
  CAST(row_number() OVER (PARTITION BY CAST(floor(l_orderkey / 50) AS BIGINT) ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) - 1 AS INTEGER) AS line_no,
  CASE WHEN l_linenumber % 3 = 0 THEN 'if x && y { ' ELSE 'x = ' END || 'p_' || (l_partkey % 40) || '(' || CAST(l_quantity AS INTEGER) || ')' AS text FROM lineitem),
call_functions AS (SELECT file_path, o AS seq, 'p_' || (o % 40) AS name, min(line_no) AS line_start, max(line_no) AS line_end FROM call_lines GROUP BY file_path, o),
call_map AS (
  SELECT DISTINCT f.file_path, f.name AS caller, c.callee
  FROM (SELECT file_path, name, arg_max(line_start, seq) AS line_start, arg_max(line_end, seq) AS line_end FROM call_functions GROUP BY file_path, name) f
  JOIN (SELECT file_path, line_no, unnest(regexp_extract_all(text, '([\\pL\\pN_]+)\\(', 1)) AS callee FROM call_lines) c ON c.file_path = f.file_path AND c.line_no BETWEEN f.line_start AND f.line_end
  WHERE f.name <> c.callee AND EXISTS (SELECT 1 FROM call_functions g WHERE g.file_path = f.file_path AND g.name = c.callee))"""

# --- a graph with cycles and long ways: nations and brands import each other, months in which orders ship those of the orders ---


def trade_edges(spark: SparkSession, d: str) -> DataFrame:
    """source, target, relation, from all items."""
    li, p, s, o = (table(spark, d, n) for n in ("lineitem", "part", "supplier", "orders"))
    met = li.select("l_orderkey", "l_partkey", "l_suppkey", "l_shipdate").join(p.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).join(s.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    met = met.join(o.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    nation, brand = F.concat(F.lit("n"), F.col("s_nationkey").cast("string")), F.col("p_brand")
    month = lambda c: F.date_format(c, "yyyy-MM")
    pairs = F.array(F.struct(brand.alias("source"), nation.alias("target")), F.struct(nation.alias("source"), brand.alias("target")), F.struct(month("l_shipdate").alias("source"), month("o_orderdate").alias("target")))
    return met.select(F.explode(pairs).alias("e")).select("e.source", "e.target").distinct().withColumn("relation", F.lit("imports"))


TRADE = """
trade_met AS (SELECT p_brand AS brand, 'n' || s_nationkey AS nation, strftime(l_shipdate, '%Y-%m') AS shipped, strftime(o_orderdate, '%Y-%m') AS ordered
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey),
trade AS (SELECT brand AS source, nation AS target FROM trade_met UNION SELECT nation, brand FROM trade_met UNION SELECT shipped, ordered FROM trade_met)"""

# --- versions of files: the events of a user are the history of a path ------------------------------------------------


def versions(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.concat(F.lit("u/"), F.col("user_id").cast("string")).alias("path"), F.struct("ts", "event_id").alias("version"), F.col("event_type").alias("signature_hash"), F.floor(F.col("value") / 40).cast("string").alias("content_hash"), "event_id")


VERSIONS = "versions AS (SELECT 'u/' || user_id AS path, ts, event_id, event_type AS signature_hash, CAST(CAST(floor(value / 40) AS BIGINT) AS VARCHAR) AS content_hash FROM events)"
