"""Catalogue queries over scans, projects, exports and edits of symbols."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import fixed, text
from ..operators import edit, export, extract, graph, incremental, outline, read, relate, summary
from ..sources import files as src
from ..sources import sinks
from . import code
from . import tables as t
from .texts import _MOVE, _OLD, _RENUM, _outline_sql, _regions, _targets

Q, O = {}, {}


def query(name: str, sql: str | None = None):
    def register(f):
        Q[name] = f
        if sql:
            O[name] = sql
        return f

    return register


# --- names, numbers, paths ----------------------------------------------------------------------------------------


@query("language_names", "SELECT * FROM (VALUES " + ", ".join(f"('{e}', '{k}', '{fixed.DISPLAY_NAMES[k]}')" for k, es in fixed.EXTENSIONS.items() for e in es) + ") AS v(ext, server_id, display_name)")
def language_names(s, d):
    return src.languages(s).select("ext", F.col("language").alias("server_id"), "display_name")


@query("symbol_kinds", "SELECT event_id, CASE event_id % 28 " + " ".join(f"WHEN {n} THEN '{k}'" for n, k in fixed.SERVER_KINDS.items()) + " ELSE 'Variable' END AS kind FROM events")
def symbol_kinds(s, d):
    return t.table(s, d, "events").select("event_id", text.symbol_kind(F.col("event_id") % 28).alias("kind"))


@query("line_counts", "SELECT doc_id, CAST(CASE WHEN coalesce(text, '') = '' THEN 0 ELSE len(string_split(text, chr(10))) - CASE WHEN text LIKE '%' || chr(10) THEN 1 ELSE 0 END END AS INTEGER) AS n FROM documents")
def line_counts(s, d):
    return t.table(s, d, "documents").select("doc_id", text.line_count(F.coalesce("text", F.lit(""))).alias("n"))


@query("path_containment", "SELECT p_partkey AS k, p_partkey % 6 IN (0, 1, 3) AS inside FROM part")
def path_containment(s, d):
    k = F.col("p_partkey")
    ways = ["src/x{}.rs", "./a/../b{}", "../x{}", "/w/p/deep/{}", "/w/project/{}", "a/../../p2/{}"]
    path = F.element_at(F.array(*[F.format_string(w.replace("{}", "%d"), k) for w in ways]), (k % 6 + 1).cast("int"))
    return t.table(s, d, "part").select(k.alias("k"), text.is_within(path, F.lit("/w/p")).alias("inside"))


@query("nested_repositories", "SELECT DISTINCT 'r' || (p_partkey % 9) AS repo FROM part WHERE p_partkey % 4 < 2")
def nested_repositories(s, d):
    k = F.col("p_partkey")
    tail = F.when(k % 4 == 0, "/.git").when(k % 4 == 1, "/.git/HEAD").when(k % 4 == 2, "/x/.git").otherwise("/src/.github")
    return src.nested_repositories(t.table(s, d, "part").select(F.concat(F.lit("r"), (k % 9).cast("string"), tail).alias("path")))


@query(
    "root_rules",
    """WITH f AS (SELECT p_partkey AS k, 'p' || (p_partkey % 4) || '/m' || (p_partkey % 3) || '/s/f' || p_partkey AS base FROM part),
    g AS (SELECT k, base, unnest(['rust', 'go', 'typescript', 'python']) AS language FROM f),
    r AS (SELECT base || CASE language WHEN 'rust' THEN '.rs' WHEN 'go' THEN '.go' WHEN 'typescript' THEN '.ts' ELSE '.py' END AS file_path, language, 'p' || (k % 4) AS p, 'p' || (k % 4) || '/m' || (k % 3) AS m, k FROM g)
    SELECT file_path, language, CASE language WHEN 'rust' THEN CASE WHEN k % 4 = 0 THEN p ELSE m END WHEN 'go' THEN CASE WHEN k % 4 = 1 THEN p ELSE m END
      WHEN 'typescript' THEN CASE WHEN k % 3 = 0 THEN p ELSE m END ELSE CASE WHEN k % 4 = 2 THEN p ELSE '' END END AS root FROM r""",
)
def root_rules(s, d):
    k, st = F.col("p_partkey"), lambda c: c.cast("string")
    base = F.concat(F.lit("p"), st(k % 4), F.lit("/m"), st(k % 3), F.lit("/s/f"), st(k))
    kinds = F.array(*[F.struct(F.lit(lang).alias("language"), F.lit(ext).alias("ext")) for lang, ext in (("rust", ".rs"), ("go", ".go"), ("typescript", ".ts"), ("python", ".py"))])
    files = t.table(s, d, "part").select(base.alias("base"), F.explode(kinds).alias("x")).select(F.concat("base", "x.ext").alias("file_path"), "x.language")
    there = []
    for p in range(4):
        there += [(f"p{p}/Cargo.toml", p == 0), (f"p{p}/package.json", False), (f"p{p}/go.mod", False)]
        for m in range(3):
            there += [(f"p{p}/m{m}/Cargo.toml", False), (f"p{p}/m{m}/go.mod", False), (f"p{p}/m{m}/package.json", False)] + ([(f"p{p}/m{m}/deno.json", False)] if m == 0 else [])
    there += [("p1/go.work", False), ("p2/.git", False)]
    return src.detect_roots(files, s.createDataFrame(there, "path string, workspace boolean"), s)


@query(
    "choose_backend",
    "SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN CASE WHEN s THEN 'server' ELSE 'unavailable' END WHEN 1 THEN CASE WHEN s THEN 'server' ELSE 'patterns' END WHEN 2 THEN CASE WHEN p THEN 'patterns' WHEN s THEN 'server' WHEN g THEN 'plugin' ELSE 'heuristic' END ELSE 'patterns' END AS backend "
    "FROM (SELECT c_custkey, c_custkey % 3 = 0 AS p, c_custkey % 5 = 0 AS s, c_custkey % 7 = 0 AS g FROM customer)",
)
def choose_backend(s, d):
    k = F.col("c_custkey")
    tool = F.element_at(F.array(*[F.lit(x) for x in ("rename_symbol", "find_references", "get_symbols", "get_imports")]), (k % 4 + 1).cast("int"))
    return t.table(s, d, "customer").select(k.alias("k"), text.choose_backend(tool, k % 3 == 0, k % 5 == 0, k % 7 == 0).alias("backend"))


@query("recent_files", "SELECT user_id, max(ts) AS last FROM events GROUP BY user_id ORDER BY last DESC, user_id LIMIT 16")
def recent_files(s, d):
    return incremental.most_recent(t.table(s, d, "events").groupBy("user_id").agg(F.max("ts").alias("last")), 16, "last", "user_id")


@query("latest_diagnostics", "SELECT user_id, arg_max(props, event_id) AS diagnostics FROM events GROUP BY user_id")
def latest_diagnostics(s, d):
    e = t.table(s, d, "events").select(F.col("user_id").alias("file_path"), F.col("props").alias("diagnostics"), F.col("event_id").alias("arrival"))
    return read.latest_diagnostics(e).withColumnRenamed("file_path", "user_id")


# --- symbols of rendered sources ----------------------------------------------------------------------------------

_E = f"WITH {code.EXPECTED}"


def _found(s, d):
    from ..operators import symbols

    return symbols.extract_symbols(code.source_lines(s, d))


@query("capped_symbols", f"{_E}, o AS (SELECT file_path, symbol, row_number() OVER (ORDER BY file_path, i) AS r FROM src_symbols) SELECT file_path, symbol, true AS truncated FROM o WHERE r <= 100")
def capped_symbols(s, d):
    return read.capped(_found(s, d), 100).select("file_path", F.col("name").alias("symbol"), "truncated")


@query("symbols_flat", f"{_E} SELECT file_path, kind || ' ' || symbol AS head, signature FROM src_symbols WHERE depth = 0")
def symbols_flat(s, d):
    flat = read.flat_text(_found(s, d).where("depth = 0"))
    return flat.select("file_path", F.regexp_extract("line", r"(?s)^(.*?) \[\d+:\d+-\d+:\d+\](?:\n|$)", 1).alias("head"), F.regexp_extract("line", r"(?s)^.*? \[\d+:\d+-\d+:\d+\]\n  (.*)$", 1).alias("signature"))


@query("symbols_json", f"{_E} SELECT file_path, CAST(count(*) AS INTEGER) AS n, string_agg(symbol, ',' ORDER BY i) AS names FROM src_symbols GROUP BY file_path")
def symbols_json(s, d):
    rows = read.as_json(_found(s, d)).select("file_path", F.from_json("json", "array<struct<name string, kind string, line_start int>>").alias("x"))
    return rows.select("file_path", F.size("x").alias("n"), F.array_join(F.transform("x", lambda p: p["name"]), ",").alias("names"))


@query("related_counts", f"{_E} SELECT symbol AS name, count(*) AS n, count(DISTINCT qualified_name) AS n_qualified FROM src_symbols GROUP BY symbol")
def related_counts(s, d):
    return relate.related_counts(_found(s, d)).drop("first_id")


@query("skeleton_nodes", f"{_E} SELECT file_path || '::' || qualified_name AS name, kind, string_split(signature, chr(10))[1] AS description FROM src_symbols")
def skeleton_nodes(s, d):
    kinds = _found(s, d)
    nodes = graph.skeletonize(graph.build_nodes(kinds, "p")).where("line_start IS NOT NULL")
    label = {"Function": "function", "Method": "method", "Struct": "struct", "Enum": "enum", "Trait": "trait", "Class": "class", "Type": "type", "Constant": "constant", "Variable": "variable", "Import": "import"}
    kind = F.lit(None).cast("string")
    for k, name in label.items():
        kind = F.when(F.get("labels", F.lit(0)) == name, k).otherwise(kind)
    return nodes.select("name", kind.alias("kind"), "description")


@query(
    "dispatch_outline",
    f"{_E}, toml AS (SELECT 'a/' || n_nationkey || '.toml' AS file_path, n_nationkey % 3 + 1 AS n FROM nation), kt AS (SELECT 'a/' || n_nationkey || '.unknown' AS file_path FROM nation) "
    "SELECT file_path, 'patterns' AS backend, count(*) AS n FROM src_symbols GROUP BY file_path UNION ALL SELECT file_path, 'toml', n FROM toml UNION ALL SELECT file_path, 'heuristic', 2 FROM kt",
)
def dispatch_outline(s, d):
    k = F.col("n_nationkey")
    sections = F.array_join(F.transform(F.sequence(F.lit(0), (k % 3).cast("int")), lambda i: F.concat(F.lit("[t"), i.cast("string"), F.lit("]\nx = [1]\n"))), "")
    nation = t.table(s, d, "nation")
    other = nation.select(F.concat(F.lit("a/"), k.cast("string"), F.lit(".toml")).alias("file_path"), sections.alias("source")).unionByName(nation.select(F.concat(F.lit("a/"), k.cast("string"), F.lit(".unknown")).alias("file_path"), F.lit("first section:\n    x\nsecond section:\n").alias("source")))
    files = src.with_language(code.source_files(s, d).select("file_path", "source").unionByName(other), s)
    lines = src.explode_lines(files).join(files.select("file_path", "ext", "language"), "file_path")
    return extract.dispatch(lines).groupBy("file_path", "backend").agg(F.count(F.lit(1)).alias("n"))


@query(
    "summary_scan",
    f"WITH {t.PATHS} SELECT path AS file_path, regexp_extract(path, '[^/]\\.([^./]+)$', 1) IN ('rs', 'py', 'ts', 'go', 'java') AND part_id % 10 <> 0 AS analysed, count(*) AS n FROM paths GROUP BY path, analysed",
)
def summary_scan(s, d):
    p = src.with_language(t.paths(s, d), s, "path").withColumnRenamed("path", "file_path")
    source = F.when(F.col("part_id") % 10 == 0, F.repeat(F.lit("\n"), F.lit(10_001))).otherwise(F.repeat(F.lit("x\n"), F.lit(10_000)))
    files = p.withColumns({"source": source, "has_patterns": F.col("language").isin(fixed.PATTERN_LANGUAGES)})
    return src.summary_scan(files).groupBy("file_path", "analysed").agg(F.count(F.lit(1)).alias("n"))


_REPORT = f"""{_E}, f AS (SELECT DISTINCT file_path, e FROM src_k), l AS (SELECT e, count(*) AS n FROM f GROUP BY e),
names(e, lang) AS (VALUES {", ".join(f"({i}, '{fixed.DISPLAY_NAMES[code.SOURCES[x][0]]}')" for i, x in enumerate(code.SOURCES))}),
y AS (SELECT symbol, count(*) AS n FROM src_symbols WHERE kind IN ({", ".join(f"'{k}'" for k in fixed.TYPE_KINDS)}) GROUP BY symbol ORDER BY n DESC, symbol LIMIT 10)
SELECT 'head' AS section, 1 AS nth, 'Project: p' AS line UNION ALL SELECT 'head', 2, 'Root: /w'
UNION ALL SELECT 'languages', 1, 'Languages: ' || string_agg(lang || ' (' || n || CASE WHEN n = 1 THEN ' file)' ELSE ' files)' END, ', ' ORDER BY n DESC, lang) FROM l JOIN names USING (e)
UNION ALL SELECT 'symbols', 1, 'Symbols: ' || count(*) || ' total' FROM src_symbols
UNION ALL SELECT 'tests', 1, 'Tests: 0 functions across 0 files'
UNION ALL SELECT 'entry points', row_number() OVER (ORDER BY file_path), '  ' || file_path || ' (main())' FROM src_symbols WHERE kind = 'Function' AND symbol = 'main'
UNION ALL SELECT 'key types', 1, '  ' || string_agg(symbol, ', ' ORDER BY n DESC, symbol) FROM y
UNION ALL SELECT 'modules', 1, '  src/ — ' || (SELECT count(*) FROM f) || ' files, ' || count(*) || ' functions' FROM src_symbols WHERE kind IN ('Function', 'Method')"""


@query("project_report", f"SELECT section, CAST(nth AS INTEGER) AS nth, line FROM ({_REPORT})")
def project_report(s, d):
    files = code.source_files(s, d).select("file_path", "language")
    return summary.project_report("p", "/w", files, _found(s, d).where(F.col("file_path").isNotNull()))


@query(
    "export_end_to_end",
    f"""{_E}, f AS (SELECT c_custkey AS k, file_path FROM src_k), n AS (SELECT file_path, count(*) AS n FROM src_symbols GROUP BY file_path)
    SELECT 'first' AS run, (SELECT count(*) FROM f) AS supported, (SELECT count(*) FROM f WHERE k % 5 <> 0) AS processed, 0 AS cached, (SELECT count(*) FROM f WHERE k % 5 = 0) AS failed, 'partial' AS status, 'full_refresh' AS refresh,
      (SELECT sum(n + 1) FROM f JOIN n USING (file_path) WHERE k % 5 <> 0) AS n_nodes
    UNION ALL SELECT 'second', (SELECT count(*) FROM f), (SELECT count(*) FROM f WHERE k % 5 = 0 OR k % 7 = 0), (SELECT count(*) FROM f WHERE k % 5 <> 0 AND k % 7 <> 0), 0, 'exported', 'partial_refresh', (SELECT sum(n + 1) FROM f JOIN n USING (file_path))""",
)
def export_end_to_end(s, d):
    path = f"{graph.shared_folder(s)}/structlens/export-{uuid.uuid4().hex}"
    k = F.regexp_extract("file_path", r"c(\d+)\.", 1).cast("long")
    files = code.source_files(s, d).withColumns({"mtime": F.lit(1).cast("long"), "size": F.length("source").cast("long"), "error": F.when(k % 5 == 0, "not UTF-8")})
    out = None
    # the second time a few files are newer, and none fails
    for run, now in (("first", files), ("second", files.withColumns({"mtime": F.when(k % 7 == 0, 2).otherwise(1).cast("long"), "error": F.lit(None).cast("string")}))):
        report = export.export(s, now, path, project="p")
        nodes, _ = export.exported(s, path)
        row = report.select(F.lit(run).alias("run"), "supported", "processed", "cached", "failed", "status", "refresh").crossJoin(nodes.agg(F.count(F.lit(1)).alias("n_nodes")))
        out = row if out is None else out.unionByName(row)
    return out


# --- edits --------------------------------------------------------------------------------------------------------


@query("insert_before_symbol", _MOVE + f", u AS (SELECT file_path, line_no::DOUBLE AS major, 0 AS minor, text FROM doc_lines UNION ALL SELECT file_path, a - 0.5, i, (['added', ''])[i + 1] FROM sp, range(0, 2) r(i)) {_RENUM}")
def insert_before_symbol(s, d):
    symbols = _regions(s, d)
    first = symbols.groupBy("file_path").agg(F.min_by("name", "seq").alias("symbol")).withColumn("content", F.lit("added"))
    return edit.insert_before_symbol(t.doc_lines(s, d), symbols, first)


@query("copy_symbol", _MOVE + f", u AS (SELECT file_path, line_no::DOUBLE AS major, 0 AS minor, text FROM doc_lines UNION ALL SELECT file_path, z + 0.5, 0, '' FROM sp UNION ALL SELECT sp.file_path, z + 0.5, l.line_no - sp.a + 1, l.text FROM sp JOIN doc_lines l ON l.file_path = sp.file_path AND l.line_no BETWEEN a AND z) {_RENUM}")
def copy_symbol(s, d):
    symbols = _regions(s, d)
    first = symbols.groupBy("file_path").agg(F.min_by("name", "seq").alias("symbol"))
    moves = first.select(F.col("file_path").alias("source_file"), "symbol", F.col("file_path").alias("target_file"), F.col("symbol").alias("target_symbol"))
    return edit.copy_symbol(t.doc_lines(s, d), symbols, moves)


@query("create_file", _OLD.format(at="0.0").split(", e AS")[0] + " SELECT file_path, line_no, text FROM doc_lines UNION ALL SELECT 'new/' || n_nationkey, CAST(i AS INTEGER), CASE WHEN i = 0 THEN n_name ELSE 'end' END FROM nation, range(0, 2) r(i)")
def create_file(s, d):
    lines = t.doc_lines(s, d)
    new = t.table(s, d, "nation").select(F.concat(F.lit("new/"), F.col("n_nationkey").cast("string")).alias("file_path"), F.concat("n_name", F.lit("\nend")).alias("content"))
    there = lines.where("line_no = 0").select("file_path", F.lit("never").alias("content"))
    return edit.create_file(lines, new.unionByName(there))


@query("resource_operations", "SELECT CASE WHEN doc_id % 4 = 1 THEN 'moved/' || doc_id ELSE 'doc/' || doc_id END AS file_path, coalesce(text, '') AS source FROM documents WHERE doc_id % 4 <> 0 UNION ALL SELECT 'made/' || n_nationkey, '' FROM nation")
def resource_operations(s, d):
    k = F.col("doc_id")
    docs = t.table(s, d, "documents")
    path = F.concat(F.lit("doc/"), k.cast("string"))
    files = docs.select(path.alias("file_path"), F.coalesce("text", F.lit("")).alias("source"))
    ops = docs.select(F.when(k % 4 == 0, "delete").when(k % 4 == 1, "rename").otherwise("create").alias("op"), path.alias("path"), F.when(k % 4 == 1, F.concat(F.lit("moved/"), k.cast("string"))).alias("new_path"))
    new = t.table(s, d, "nation").select(F.lit("create").alias("op"), F.concat(F.lit("made/"), F.col("n_nationkey").cast("string")).alias("path"), F.lit(None).cast("string").alias("new_path"))
    return edit.resource_operations(files, ops.unionByName(new))


@query("rebuild_text", f"WITH {t.DOC} SELECT file_path, string_agg(text, chr(10) ORDER BY line_no) || chr(10) AS source FROM doc_lines GROUP BY file_path")
def rebuild_text(s, d):
    return sinks.rebuild_text(t.doc_lines(s, d))


@query("edit_preview_files", "SELECT l_orderkey AS file_path, count(*) AS n_edits FROM lineitem GROUP BY l_orderkey")
def edit_preview_files(s, d):
    return edit.preview_files(t.table(s, d, "lineitem").select(F.col("l_orderkey").alias("file_path")))


_TARGET = r"first AS (SELECT file_path, regexp_extract(text, '([A-Za-z_]\w*)', 1) AS target FROM doc_lines WHERE line_no = 0)"


@query(
    "rename_symbol",
    f"WITH {t.DOC}, {_TARGET}" + r""", w AS (SELECT f.file_path, source, target, regexp_extract_all(source, '[\pL_][\pL\pN_]*') AS names, regexp_split_to_array(source, '[\pL_][\pL\pN_]*') AS gaps FROM doc_files f LEFT JOIN first USING (file_path)),
    x AS (SELECT *, unnest(range(1, len(gaps) + 1)) AS i FROM w)
    SELECT file_path, string_agg(gaps[i] || CASE WHEN i > len(names) THEN '' WHEN names[i] = target THEN 'renamed_it' ELSE names[i] END, '' ORDER BY i) AS source FROM x GROUP BY file_path""",
)
def rename_symbol(s, d):
    lines, targets = t.doc_lines(s, d), _targets(s, d)
    refs = relate.find_references(targets, lines)
    names = targets.select("file_path", F.col("text").alias("target"), F.lit("renamed_it").alias("new_name"))
    return edit.apply_edits(t.doc_files(s, d), relate.rename_edits(refs, names, lines))


@query("references_without_definitions", f"WITH {t.DOC}, {_TARGET}" + r""", w AS (SELECT file_path, unnest(regexp_extract_all(text, '([\pL_][\pL\pN_]*)', 1)) AS x FROM doc_lines)
SELECT f.file_path, f.target, count(*) - 1 AS n FROM w JOIN first f ON f.file_path = w.file_path AND f.target = w.x GROUP BY ALL HAVING count(*) > 1""")
def references_without_definitions(s, d):
    lines, targets = t.doc_lines(s, d), _targets(s, d)
    refs = relate.find_references(targets, lines)
    first = refs.groupBy("file_path", "target").agg(F.min(F.struct("line_no", "col")).alias("x")).select("file_path", "target", "x.line_no", "x.col")
    return relate.find_references(targets, lines, first).groupBy("file_path", "target").agg(F.count(F.lit(1)).alias("n"))


@query(
    "region_by_id",
    f"WITH {t.DOC}, {_outline_sql('doc')}, p AS (SELECT file_path, region_id, line, line_end FROM outline WHERE line % 2 = 0) SELECT * FROM p UNION ALL SELECT file_path, file_path || '::' || label || '@' || (line - 1) || ':0', line, line_end FROM outline WHERE line % 2 = 1",
)
def region_by_id(s, d):
    plain = outline.outline(t.doc_lines(s, d), hashed=False)
    stable = F.concat("file_path", F.lit("::"), "label", F.lit("@"), (F.col("line") - 1).cast("string"), F.lit(":0"))
    symbols = plain.select("file_path", stable.alias("stable_id"), (F.col("line") - 1).alias("line_start"), (F.col("line_end") - 1).alias("line_end"))
    wanted = plain.select("file_path", F.when(F.col("line") % 2 == 0, F.col("region_id")).otherwise(stable).alias("region_id"))
    return read.get_region(wanted, plain.where("false"), plain, symbols)
