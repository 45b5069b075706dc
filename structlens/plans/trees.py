"""Catalogue queries over trees of files and of symbols, streams with state that expires, and tables under a manifest."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, read, symbols, table_function
from ..sources import files as src
from ..sources import server, sinks, tree, worktrees
from ..streaming import expiry, index
from . import code
from . import tables as t

Q, O = {}, {}


def query(name: str, sql: str | None = None):
    def register(f):
        Q[name] = f
        if sql:
            O[name] = sql
        return f

    return register


def _folder(spark: SparkSession, label: str) -> str:
    return f"{graph.shared_folder(spark)}/structlens/{label}-{uuid.uuid4().hex}"


def _write(rows) -> None:
    for row in rows:
        os.makedirs(os.path.dirname(row.at), exist_ok=True)
        with open(row.at, "w", encoding="utf-8") as out:
            out.write(row.source)


_REL = "'s' || (s_suppkey % 5) || '/_in' || (s_suppkey % 3) || '/__init__' || s_suppkey || '.py'"


@query(
    "scan_tree",
    f"SELECT {_REL} AS file_path, 'python' AS language, CAST(length(s_name) + 5 AS BIGINT) AS size_bytes, 1 AS n_symbols FROM supplier "
    "WHERE s_suppkey % 5 <> 4 AND NOT (s_suppkey % 5 = 1 AND s_suppkey % 3 = 0) AND NOT (s_suppkey % 5 = 2 AND s_suppkey % 3 = 1 AND s_suppkey % 10 = 7)",
)
def scan_tree(s, d):
    """A module for each supplier, and ignore files at three depths."""
    root = _folder(s, "tree").removeprefix("file://")
    k = F.col("s_suppkey")
    rel = F.concat(F.lit("s"), (k % 5).cast("string"), F.lit("/_in"), (k % 3).cast("string"), F.lit("/__init__"), k.cast("string"), F.lit(".py"))
    modules = t.table(s, d, "supplier").select(F.concat(F.lit(root + "/"), rel).alias("at"), F.concat(F.lit("def "), F.regexp_replace("s_name", r"\W", "_"), F.lit(":")).alias("source"))
    rules = s.createDataFrame([(f"{root}/.gitignore", "s4/\n"), (f"{root}/s1/.gitignore", "_in0/\n"), (f"{root}/s2/_in1/.gitignore", "*7.py\n!*.txt\n")], "at string, source string")
    modules.unionByName(rules).foreachPartition(_write)
    found = tree.scan_tree(s, root)
    n = symbols.from_sources(found).groupBy("file_path").agg(F.count(F.lit(1)).cast("int").alias("n_symbols"))
    return found.join(n, "file_path").select("file_path", "language", "size_bytes", "n_symbols")


@query(
    "server_symbols",
    """WITH c AS (SELECT c_custkey AS k, c_custkey % 6 + 1 AS depth, CAST(l AS INTEGER) AS l FROM customer, range(6) r(l) WHERE l < c_custkey % 6 + 1),
    x AS (SELECT k, l, array_to_string(list_transform(range(l), lambda i: 'n' || k || '_' || i), '/') AS above FROM c)
    SELECT 'f' || k AS file_path, 2 * l AS seq, CASE WHEN l > 0 THEN 2 * l - 2 END AS parent_seq, l AS depth, 'n' || k || '_' || l AS symbol, CASE WHEN l % 2 = 0 THEN 'Class' ELSE 'Function' END AS kind, l AS line_start, 20 - l AS line_end, 'd' || l AS signature, above AS scope FROM x
    UNION ALL SELECT 'f' || k, 2 * l + 1, 2 * l, l + 1, 'leaf_' || l, 'Variable', 30 + l, 30 + l, NULL, CASE WHEN above = '' THEN '' ELSE above || '/' END || 'n' || k || '_' || l FROM x""",
)
def server_symbols(s, d):
    """A chain of blocks, one to six deep, with a leaf in each."""
    k = F.col("c_custkey").cast("string")
    node = F.lit(None).cast("string")
    for level in range(5, -1, -1):
        leaf = f'{{"name":"leaf_{level}","kind":13,"range":{{"start":{{"line":{30 + level},"character":0}},"end":{{"line":{30 + level},"character":4}}}}}}'
        head = F.concat(F.lit('{"name":"n'), k, F.lit(f'_{level}","kind":{(5, 12)[level % 2]},"detail":"d{level}","range":{{"start":{{"line":{level},"character":0}},"end":{{"line":{20 - level},"character":1}}}},"children":[{leaf}'))
        node = F.when(F.col("c_custkey") % 6 >= level, F.concat(head, F.coalesce(F.concat(F.lit(","), node), F.lit("")), F.lit("]}")))
    answers = t.table(s, d, "customer").select(F.concat(F.lit("f"), k).alias("file_path"), F.concat(F.lit("["), node, F.lit("]")).alias("json"))
    found = server.server_symbols(answers)
    return found.select("file_path", "seq", "parent_seq", "depth", F.col("name").alias("symbol"), "kind", "line_start", "line_end", "signature", F.array_join("scope_path", "/").alias("scope"))


@query(
    "capped_by_subtree",
    f"""WITH {code.EXPECTED}, s AS (SELECT *, CASE WHEN depth = 1 THEN 2 ELSE i END AS root FROM src_symbols WHERE contains(lower(symbol), 'o')), c AS (SELECT file_path, root, count(*) AS n FROM s GROUP BY ALL),
    p AS (SELECT *, coalesce(sum(n) OVER (ORDER BY file_path, root ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c) SELECT s.file_path, s.symbol, s.kind, true AS truncated FROM s JOIN p USING (file_path, root) WHERE before < 101""",
)
def capped_by_subtree(s, d):
    return read.capped_by_subtree(symbols.extract_symbols(code.source_lines(s, d)), "O", 101).select("file_path", F.col("name").alias("symbol"), "kind", "truncated")


@query("symbols_by_sql", f"WITH {code.EXPECTED} SELECT file_path, kind, symbol, line_start, line_end, signature FROM src_symbols")
def symbols_by_sql(s, d):
    """The extractor as a table function."""
    table_function.register(s)
    code.source_lines(s, d).createOrReplaceTempView("structlens_source_lines")
    return s.sql("SELECT file_path, kind, name AS symbol, line_start, line_end, signature FROM extract_symbols(TABLE(structlens_source_lines) PARTITION BY (file_path) ORDER BY (line_no), 'outline')")


# --- streams --------------------------------------------------------------------------------------------------------


def _stream(s: SparkSession, d: str) -> DataFrame:
    # as a pattern, so that it may be one file or a folder of them
    return s.readStream.schema(s.read.parquet(f"{d}/events.parquet").schema).parquet(f"{d}/events.parque[t]")


@query(
    "served_summaries",
    """WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS key, ts AS asked, props AS text, row_number() OVER (PARTITION BY user_id ORDER BY ts, props) AS r FROM events),
    s AS (SELECT key, r, asked, asked AS made, text, false AS cached FROM e WHERE r = 1 UNION ALL
      SELECT e.key, e.r, e.asked, CASE WHEN e.asked < s.made + INTERVAL 6 HOUR THEN s.made ELSE e.asked END, CASE WHEN e.asked < s.made + INTERVAL 6 HOUR THEN s.text ELSE e.text END, e.asked < s.made + INTERVAL 6 HOUR FROM s JOIN e ON e.key = s.key AND e.r = s.r + 1)
    SELECT key, asked, made, text, cached FROM s""",
)
def served_summaries(s, d):
    """Requests as a stream; a summary is good for six hours."""
    asked = _stream(s, d).select(F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("asked"), F.col("props").alias("text"))
    out = _folder(s, "summaries")
    served = expiry.served_summaries(asked, seconds=6 * 3600)
    served.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    rows = s.read.schema(expiry.RESULT).parquet(f"{out}/rows")
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("asked", "made")})


@query("diagnostics_stream", "SELECT user_id AS file_path, arg_max(props, event_id) AS diagnostics FROM events GROUP BY user_id")
def diagnostics_stream(s, d):
    out = _folder(s, "diagnostics")
    sent = _stream(s, d).select(F.col("user_id").alias("file_path"), F.col("props").alias("diagnostics"), F.col("event_id").alias("arrival"))
    expiry.keep_diagnostics(sent, f"{out}/rows", f"{out}/state").awaitTermination()
    return s.read.parquet(f"{out}/rows")


@query(
    "merged_index",
    "SELECT path, version, signature_hash, content_hash FROM (SELECT 'u' || user_id AS path, ts AS version, event_type AS signature_hash, props AS content_hash, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type DESC, props DESC) AS r FROM events) WHERE r = 1 AND signature_hash <> 'error'",
)
def merged_index(s, d):
    """The index that a stream of file versions leaves behind, under its manifest."""
    out = _folder(s, "index")
    sent = _stream(s, d).select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), F.col("ts").cast("timestamp").alias("version"), F.col("event_type").alias("signature_hash"), F.col("props").alias("content_hash"), (F.col("event_type") == "error").alias("deleted"))
    index.merge_batches(sent, f"{out}/rows", f"{out}/state").awaitTermination()
    return index.read_merged(s, f"{out}/rows").select("path", F.col("version").cast("timestamp_ntz").alias("version"), "signature_hash", "content_hash")


@query("versioned_table", "SELECT p_partkey AS k, CASE WHEN p_partkey % 7 = 0 THEN p_size + 100 ELSE p_size END AS size FROM part UNION ALL SELECT -p_partkey - 1, p_size FROM part WHERE p_partkey % 11 = 0")
def versioned_table(s, d):
    """All parts, then changes of some and new ones: only their buckets are written again."""
    path = _folder(s, "versions")
    part = t.table(s, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("size"))
    sinks.write_version(part, path, prune=True, keys=["k"])
    sinks.write_version(part.where("k % 7 = 0").withColumn("size", F.col("size") + 100), path, prune=False, keys=["k"])
    sinks.write_version(part.where("k % 11 = 0").withColumn("k", -F.col("k") - 1), path, prune=False, keys=["k"])
    return sinks.read_version(s, path)


@query(
    "worktrees",
    """SELECT '/w/p' || k || '/sub' AS root, CASE k % 5 WHEN 0 THEN '/w/p' || k || '/.git' WHEN 1 THEN '/m/.git/worktrees/w' || k WHEN 2 THEN '/w/m/.git/modules/p' || k END AS git_dir,
    CASE WHEN k % 5 < 3 THEN 'ref: refs/heads/b' || k || chr(10) END AS head, CASE k % 5 WHEN 0 THEN 'main' WHEN 1 THEN 'w' || k WHEN 2 THEN '/w/m/.git/modules/p' || k END AS worktree_id FROM (SELECT s_suppkey AS k FROM supplier)""",
)
def projects(s, d):
    """A plain checkout, a linked worktree, a submodule, a marker that names nothing, and no marker at all."""
    k = F.col("s_suppkey")
    n, kind = k.cast("string"), k % 5
    suppliers = t.table(s, d, "supplier")
    marker = F.concat(F.lit("/w/p"), n, F.lit("/.git"))
    content = F.when(kind == 1, F.concat(F.lit("gitdir: /m/.git/worktrees/w"), n, F.lit("\n"))).when(kind == 2, F.concat(F.lit("gitdir: ../m/./.git/modules/p"), n, F.lit("\n"))).when(kind == 3, F.lit("nothing"))
    marks = suppliers.where(kind < 4).select(marker.alias("path"), (kind == 0).alias("is_dir"), content.alias("content"))
    git = F.when(kind == 0, marker).when(kind == 1, F.concat(F.lit("/m/.git/worktrees/w"), n)).otherwise(F.concat(F.lit("/w/m/.git/modules/p"), n))
    heads = suppliers.where(kind < 3).select(F.concat(git, F.lit("/HEAD")).alias("path"), F.lit(False).alias("is_dir"), F.concat(F.lit("ref: refs/heads/b"), n, F.lit("\n")).alias("content"))
    roots = suppliers.select(F.concat(F.lit("/w/p"), n, F.lit("/sub")).alias("root"))
    return worktrees.worktrees(roots, marks.unionByName(heads)).select("root", "git_dir", "head", "worktree_id")


@query("scan_failures", "SELECT count(*) AS supported, count(*) FILTER (p_size > 40) AS failed FROM part")
def scan_failures(s, d):
    rows = t.table(s, d, "part").select(F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("file_path"), F.when(F.col("p_size") > 40, "not UTF-8").alias("error"))
    return src.scan_counters(rows).select("supported", "failed")
