"""Catalogue queries over symbols, calls and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, text
from ..operators import graph, impact, read, relate, summary
from . import tables as t

Q, O = {}, {}


def query(name: str, sql: str | None = None):
    def register(f):
        Q[name] = f
        if sql:
            O[name] = sql
        return f

    return register


_W = f"WITH {t.SYMBOLS}"
_TYPES = ", ".join(f"'{k}'" for k in fixed.TYPE_KINDS)


@query("get_symbols", f"{_W} SELECT file_path, seq, name, qualified_name, stable_id, kind, line_start, line_end, signature FROM symbols")
def get_symbols(s, d):
    return read.get_symbols(t.symbols(s, d))


@query("get_structure", f"{_W} SELECT file_path, string_agg(repeat('  ', depth) || kind || ' ' || name, chr(10) ORDER BY seq) AS structure FROM symbols WHERE depth <= 1 GROUP BY file_path")
def get_structure(s, d):
    return read.get_structure(t.symbols(s, d), depth=1)


def _symbol_lines(symbols):
    """A line of text for each symbol, at its place."""
    return symbols.select("file_path", F.col("seq").alias("line_no"), F.concat_ws(" ", F.col("kind"), F.col("name")).alias("text"))


@query(
    "get_definition",
    f"""{_W}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_path, name ORDER BY seq) AS r FROM symbols) WHERE r = 1),
    l AS (SELECT f.file_path, f.name, f.kind, f.line_start, f.line_end, list(s.kind || ' ' || s.name ORDER BY s.seq) AS b FROM f JOIN symbols s ON s.file_path = f.file_path AND s.seq BETWEEN f.line_start AND f.line_end GROUP BY ALL)
    SELECT file_path, name, kind, line_start, line_end, CASE WHEN len(b) > 50 THEN array_to_string(b[1:11], chr(10)) || chr(10) || '... (' || (len(b) - 11) || ' more lines)' ELSE array_to_string(b, chr(10)) END AS body FROM l""",
)
def get_definition(s, d):
    symbols = t.symbols(s, d)
    return read.get_definition(symbols, _symbol_lines(symbols))


@query("search_symbols", f"{_W} SELECT file_path, seq, name, kind, (SELECT count(*) FROM symbols WHERE contains(lower(name), 'urgent') AND kind = 'Method') > 40 AS truncated FROM symbols WHERE contains(lower(name), 'urgent') AND kind = 'Method' ORDER BY file_path, seq LIMIT 40")
def search_symbols(s, d):
    return read.search_symbols(t.symbols(s, d), "URGENT", kind="Method", limit=40).select("file_path", "seq", "name", "kind", "truncated")


@query("get_signature", f"{_W} SELECT file_path, name, coalesce(signature, name || ' (no signature available)') AS signature FROM (SELECT *, row_number() OVER (PARTITION BY file_path, name ORDER BY seq) AS r FROM symbols) WHERE r = 1")
def get_signature(s, d):
    return read.get_signature(t.symbols(s, d))


@query("get_imports", f"{_W} SELECT file_path, seq, name FROM symbols WHERE kind = 'Import' AND seq % 2 = 0")
def get_imports(s, d):
    flat = t.symbols(s, d).withColumn("depth", F.when(F.col("seq") % 2 == 0, 0).otherwise(F.col("depth")))
    return read.get_imports(flat).select("file_path", "seq", "name")


@query(
    "get_exports",
    rf"""{_W}, e AS (SELECT *, regexp_extract(file_path, '[^/]\.([^./]+)$', 1) AS ext FROM symbols)
    SELECT file_path, seq, name FROM e WHERE coalesce(CASE ext WHEN 'rs' THEN starts_with(signature, 'pub ') OR starts_with(signature, 'pub(') WHEN 'py' THEN NOT starts_with(name, '_')
      WHEN 'ts' THEN contains(signature, 'export') WHEN 'go' THEN regexp_matches(name, '^\p{{Lu}}') ELSE true END, false)""",
)
def get_exports(s, d):
    return read.get_exports(t.symbols(s, d)).select("file_path", "seq", "name")


@query("chunk_boundaries", f"{_W} SELECT 'Class' AS strategy, file_path, seq FROM symbols WHERE depth = 1 AND kind IN ('Class', 'Struct') UNION ALL SELECT 'TopLevel', file_path, seq FROM symbols WHERE depth = 1 AND kind NOT IN ('Variable', 'Import')")
def chunk_boundaries(s, d):
    top = t.symbols(s, d).where("depth = 1").withColumn("depth", F.lit(0))
    one = [read.chunk_boundaries(top, k).select(F.lit(k).alias("strategy"), "file_path", "seq") for k in ("Class", "TopLevel")]
    return one[0].unionByName(one[1])


@query(
    "get_scope",
    f"""{_W}, {t.POSITIONS}, m AS (SELECT p.file_path, p.line, qualified_name, kind, row_number() OVER (PARTITION BY p.file_path, p.line ORDER BY line_end - line_start, seq) AS r FROM positions p LEFT JOIN symbols s ON s.file_path = p.file_path AND p.line BETWEEN line_start AND line_end)
    SELECT file_path, line, coalesce(qualified_name, 'Top-level scope') AS scope, kind FROM m WHERE r = 1""",
)
def get_scope(s, d):
    return read.get_scope(t.positions(s, d), t.symbols(s, d))


@query(
    "enclosing_class",
    f"""{_W}, c AS (SELECT file_path, parent_seq, name AS method, seq FROM symbols WHERE parent_seq IS NOT NULL), f AS (SELECT file_path, method, min(parent_seq) AS p FROM c GROUP BY ALL),
    m AS (SELECT file_path, parent_seq AS p, string_agg(method, ',' ORDER BY seq) AS members FROM c GROUP BY ALL)
    SELECT file_path, method, s.name AS class_name, s.kind AS class_kind, members FROM f JOIN m USING (file_path, p) JOIN symbols s ON s.file_path = f.file_path AND s.seq = f.p""".replace("SELECT file_path, method, s.name", "SELECT f.file_path, method, s.name"),
)
def enclosing_class(s, d):
    return read.enclosing_class(t.symbols(s, d))


@query(
    "symbol_body_hint",
    f"""{_W}, h AS (SELECT DISTINCT file_path, name, CASE WHEN depth = 2 THEN 40 END AS hint FROM symbols), m AS (SELECT h.file_path, h.name, h.hint, stable_id, line_start, line_end, row_number() OVER (PARTITION BY h.file_path, h.name, h.hint ORDER BY coalesce(abs(line_start - hint), 0), seq) AS r FROM h JOIN symbols s ON s.file_path = h.file_path AND s.name = h.name)
    SELECT file_path, name, CAST(hint AS INTEGER) AS hint, stable_id, line_start, line_end FROM m WHERE r = 1""",
)
def symbol_body_hint(s, d):
    symbols = t.symbols(s, d)
    return read.symbol_body(symbols.select("file_path", "name", F.when(F.col("depth") == 2, 40).alias("hint")).distinct(), symbols)


@query(
    "type_definitions",
    f"""{_W}, m AS (SELECT file_path, parent_seq AS seq, string_agg(name, ',' ORDER BY seq) AS members FROM (SELECT file_path, parent_seq, name, seq FROM symbols WHERE parent_seq IS NOT NULL) GROUP BY file_path, parent_seq)
    SELECT s.file_path, s.seq, name, kind, string_split(doc_comment, chr(10))[1] AS doc, coalesce(members, '') AS members FROM symbols s LEFT JOIN m ON m.file_path = s.file_path AND m.seq = s.seq WHERE kind IN ({_TYPES})""",
)
def type_definitions(s, d):
    return read.type_definitions(t.symbols(s, d))


@query(
    "summarize_file",
    f"""{_W} SELECT file_path, string_agg(CASE WHEN doc_comment IS NOT NULL THEN repeat('  ', depth) || '/// ' || string_split(doc_comment, chr(10))[1] || chr(10) ELSE '' END || repeat('  ', depth) || coalesce(signature, kind || ' ' || name), chr(10) ORDER BY seq) AS summary FROM symbols GROUP BY file_path""",
)
def summarize_file(s, d):
    return read.summarize_file(t.symbols(s, d))


@query(
    "get_tests",
    rf"""{_W}, e AS (SELECT *, regexp_extract(file_path, '[^/]\.([^./]+)$', 1) AS ext FROM symbols)
    SELECT file_path, seq, name FROM e WHERE CASE ext WHEN 'rs' THEN kind = 'Method' AND EXISTS (SELECT 1 FROM symbols b WHERE b.file_path = e.file_path AND b.seq BETWEEN e.seq - 5 AND e.seq - 1 AND b.kind = 'Class') WHEN 'py' THEN (kind = 'Method' AND starts_with(name, 'test_')) OR (kind = 'Class' AND starts_with(name, 'Test'))
      WHEN 'ts' THEN kind = 'Method' AND (contains(name, 'test') OR contains(name, 'it') OR contains(name, 'describe')) ELSE starts_with(name, 'test') END""",
)
def get_tests(s, d):
    symbols = t.symbols(s, d)
    lines = symbols.select("file_path", F.col("seq").alias("line_no"), F.when(F.col("kind") == "Class", "#[test]").otherwise("x").alias("text"))
    return read.get_tests(symbols, lines).select("file_path", "seq", "name")


@query(
    "parameters",
    f"""{_W} SELECT file_path, seq, name, p AS position, (['key', 'n'])[p + 1] AS parameter, (['Map<u64, str>', 'u32'])[p + 1] AS type FROM symbols, (SELECT CAST(unnest([0, 1]) AS INTEGER) AS p) WHERE kind = 'Method' AND signature IS NOT NULL""",
)
def parameters(s, d):
    return read.get_parameters(t.symbols(s, d))


_C = f"WITH {t.CALLS}"


def _calls(s, d):
    return relate.dependency_map(t.call_functions(s, d), t.call_lines(s, d))


@query("dependency_map", f"{_C} SELECT * FROM call_map")
def dependency_map(s, d):
    return _calls(s, d)


@query(
    "callers_callees",
    f"""{_C}, i AS (SELECT file_path, callee AS name, string_agg(DISTINCT caller, ',' ORDER BY caller) AS callers FROM call_map GROUP BY ALL), o AS (SELECT file_path, caller AS name, string_agg(DISTINCT callee, ',' ORDER BY callee) AS callees FROM call_map GROUP BY ALL)
    SELECT file_path, name, coalesce(callers, '') AS callers, coalesce(callees, '') AS callees FROM i FULL JOIN o USING (file_path, name)""",
)
def callers_callees(s, d):
    return relate.callers_and_callees(_calls(s, d))


@query("call_hierarchy", f"{_C} SELECT file_path, caller AS name, 'outgoing' AS direction, callee AS other FROM call_map UNION ALL SELECT file_path, callee, 'incoming', caller FROM call_map")
def call_hierarchy(s, d):
    return relate.call_hierarchy(_calls(s, d))


_BRANCH = " + ".join(f"(length(t) - length(replace(t, '{k}', ''))) // {len(k)}" for k in fixed.BRANCHES)


@query(
    "function_complexity",
    f"""{_C}, l AS (SELECT file_path, line_no, {_BRANCH} AS n FROM (SELECT file_path, line_no, trim(text) AS t FROM call_lines)),
    c AS (SELECT f.file_path, f.seq, f.name, f.line_start, f.line_end, CAST(1 + sum(n) AS BIGINT) AS complexity FROM call_functions f JOIN l ON l.file_path = f.file_path AND l.line_no BETWEEN f.line_start AND f.line_end GROUP BY ALL)
    SELECT *, CASE WHEN complexity <= 5 THEN 'simple' WHEN complexity <= 10 THEN 'moderate' WHEN complexity <= 20 THEN 'complex' ELSE 'very complex' END AS rating FROM c""",
)
def function_complexity(s, d):
    return read.complexity(t.call_functions(s, d), t.call_lines(s, d))


@query("related_symbols", "SELECT a.p_partkey AS stable_id, b.p_partkey AS related_id, a.p_brand = b.p_brand AS same_qualified FROM part a JOIN part b ON substring(a.p_name, 1, 12) || a.p_size = substring(b.p_name, 1, 12) || b.p_size AND a.p_partkey <> b.p_partkey")
def related_symbols(s, d):
    p = t.table(s, d, "part").select(F.concat(F.substring("p_name", 1, 12), F.col("p_size").cast("string")).alias("name"), F.col("p_partkey").alias("stable_id"), F.col("p_brand").alias("qualified_name"))
    return relate.related_symbols(p)


_REFS = "refs AS (SELECT 'n/' || (o_custkey % 25) || CASE WHEN o_orderkey % 9 = 0 THEN '/tests/a.rs' ELSE '/a.rs' END AS file_path, p_brand || p_size || '_' || (o_orderkey % 16) AS target, CASE WHEN o_custkey % 3 = 0 THEN 'c' || (o_custkey % 10) WHEN o_custkey % 31 = 0 THEN 'test' END AS caller, CASE WHEN o_custkey % 7 = 1 THEN 'd' || (o_custkey % 10) END AS callee FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"


def _references(s, d):
    li, o, p = t.table(s, d, "lineitem").select("l_orderkey", "l_partkey"), t.table(s, d, "orders").select("o_orderkey", "o_custkey"), t.table(s, d, "part").select("p_partkey", "p_brand", "p_size")
    met = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    k, ten = F.col("o_custkey"), (F.col("o_custkey") % 10).cast("string")
    path = F.concat(F.lit("n/"), (F.col("o_custkey") % 25).cast("string"), F.when(F.col("o_orderkey") % 9 == 0, "/tests/a.rs").otherwise("/a.rs"))
    return met.select(path.alias("file_path"), F.concat("p_brand", F.col("p_size").cast("string"), F.lit("_"), (F.col("o_orderkey") % 16).cast("string")).alias("target"), F.when(k % 3 == 0, F.concat(F.lit("c"), ten)).when(k % 31 == 0, "test").alias("caller"), F.when(k % 7 == 1, F.concat(F.lit("d"), ten)).alias("callee"))


@query("references_by_file", f"WITH {_REFS} SELECT file_path, count(*) AS n_references FROM refs GROUP BY file_path")
def references_by_file(s, d):
    return relate.references_by_file(_references(s, d))


@query(
    "analyze_impact",
    f"""WITH {_REFS}, k AS (SELECT DISTINCT target FROM refs), r AS (SELECT target, count(*) AS n_references, count(DISTINCT file_path) AS n_files, max(contains(file_path, 'test')::INT) AS t1 FROM refs GROUP BY target),
    c AS (SELECT target, count(DISTINCT caller) AS n_callers, max(contains(caller, 'test')::INT) AS t2 FROM refs GROUP BY target),
    a AS (SELECT target, count(DISTINCT callee) AS n_callees FROM refs GROUP BY target),
    g AS (SELECT k.target, coalesce(n_references, 0) AS n_references, coalesce(n_files, 0) AS n_files, coalesce(n_callers, 0) AS n_callers, coalesce(n_callees, 0) AS n_callees, greatest(coalesce(t1, 0), coalesce(t2, 0)) AS tested,
      length(k.target) % 2 AS n_same, length(k.target) % 3 AS n_ambiguous FROM k LEFT JOIN r USING (target) LEFT JOIN c USING (target) LEFT JOIN a USING (target))
    SELECT target, n_references, n_files, n_callers, n_callees, CASE WHEN n_files = 0 OR (n_files <= 1 AND n_references <= 2) THEN 'low' WHEN n_files <= 3 AND n_references <= 6 THEN 'medium' ELSE 'high' END AS risk,
      concat_ws(',', CASE WHEN n_files > 1 THEN 'cross-file references' END, CASE WHEN n_references > 5 THEN 'many references' END, CASE WHEN n_callers > 0 THEN 'has local callers' END, CASE WHEN n_callees > 0 THEN 'has downstream local callees' END, CASE WHEN tested = 1 THEN 'touches tests' END,
        CASE WHEN n_same > 0 THEN 'same scoped symbol elsewhere in project' END, CASE WHEN n_ambiguous > 0 THEN 'same-name symbols elsewhere in project,related symbol matching is name-based' END) AS factors,
      CASE WHEN n_same > 0 OR n_ambiguous > 0 THEN 'heuristic' ELSE 'strong' END AS confidence FROM g""",
)
def analyze_impact(s, d):
    r = _references(s, d)
    size = F.length("target")
    targets = r.select("target").distinct().select("target", (size % 2).alias("n_same"), (size % 3).alias("n_ambiguous"))
    return impact.analyze_impact(targets, r, r.select("target", "caller"), r.select("target", "callee"))


@query(
    "blast_radius",
    """WITH sy AS (SELECT DISTINCT p_brand || CASE WHEN p_size % 2 = 0 THEN '_' || p_size ELSE '' END AS name, CASE WHEN p_size % 7 = 0 THEN 'a/tests/' ELSE 'src/' END || (p_partkey % 30) || '.rs' AS file_path FROM part),
    tg AS (SELECT name AS symbol, min(file_path) AS file_path FROM sy GROUP BY name),
    m AS (SELECT DISTINCT tg.symbol, tg.file_path, sy.file_path AS f FROM tg JOIN sy ON contains(lower(sy.name), lower(tg.symbol)) AND sy.file_path <> tg.file_path),
    c AS (SELECT tg.symbol, tg.file_path, count(f) AS direct, count(*) FILTER (f LIKE '%/test%') AS tests FROM tg LEFT JOIN m USING (symbol, file_path) GROUP BY ALL)
    SELECT *, least(1.0::DOUBLE, (direct * 2.0::DOUBLE + 0.0::DOUBLE + tests) / 10.0::DOUBLE) AS risk FROM c""",
)
def blast_radius(s, d):
    p = t.table(s, d, "part")
    sy = p.select(F.concat("p_brand", F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("_"), F.col("p_size").cast("string"))).otherwise("")).alias("name"), F.concat(F.when(F.col("p_size") % 7 == 0, "a/tests/").otherwise("src/"), (F.col("p_partkey") % 30).cast("string"), F.lit(".rs")).alias("file_path")).distinct()
    return impact.blast_radius(sy.groupBy(F.col("name").alias("symbol")).agg(F.min("file_path").alias("file_path")), sy)


@query(
    "transitive_dependents",
    f"""WITH RECURSIVE {t.TRADE}, m AS (SELECT min(ordered) AS first FROM trade_met), r AS (SELECT 'n0' AS seed, 'n0' AS node, 0 AS distance UNION ALL SELECT first, first, 0 FROM m UNION SELECT seed, source, distance + 1 FROM r JOIN trade ON target = node WHERE distance < 120)
    SELECT seed, node, CAST(min(distance) AS INTEGER) AS distance FROM r GROUP BY seed, node""",
)
def transitive_dependents(s, d):
    edges = t.trade_edges(s, d)
    month = t.table(s, d, "orders").agg(F.date_format(F.min("o_orderdate"), "yyyy-MM").alias("seed"))
    return graph.reachable(edges, month.unionByName(s.createDataFrame([("n0",)], "seed string")))


_LABELS = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{','.join(v)}'" for k, v in fixed.LABELS.items()) + " END"


@query(
    "graph_nodes",
    f"""{_W} SELECT file_path || '::' || qualified_name AS name, concat_ws(',', {_LABELS}, CASE WHEN starts_with(signature, 'pub ') OR starts_with(signature, 'pub(') THEN 'public' END, CASE WHEN contains(signature, 'async') THEN 'async' END) AS labels,
      concat_ws(chr(10) || chr(10), signature, doc_comment) AS description, file_path, line_start, line_end FROM symbols
    UNION ALL SELECT DISTINCT file_path, 'file', file_path, file_path, NULL, NULL FROM symbols""",
)
def graph_nodes(s, d):
    n = graph.build_nodes(t.symbols(s, d), "p")
    return n.select("name", F.array_join("labels", ",").alias("labels"), "description", "file_path", "line_start", "line_end")


_NAMED = "n AS (SELECT s.file_path, s.kind, s.file_path || '::' || s.qualified_name AS name, p.file_path || '::' || p.qualified_name AS parent FROM symbols s LEFT JOIN symbols p ON p.file_path = s.file_path AND p.seq = s.parent_seq)"


@query("graph_edges", f"{_W}, {_NAMED} SELECT coalesce(parent, file_path) AS source, name AS target, 'contains' AS relation, 1.0::DOUBLE AS weight FROM n UNION ALL SELECT file_path, name, 'imports', 0.5::DOUBLE FROM n WHERE kind = 'Import'")
def graph_edges(s, d):
    return graph.build_edges(t.symbols(s, d), "p").select("source", "target", "relation", "weight")


@query(
    "graph_merge",
    """WITH g AS (SELECT c_nationkey AS graph_no, c_custkey AS node_no, 'k' || (c_custkey % 300) AS name FROM customer), n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY graph_no, node_no) AS r FROM g) WHERE r = 1)
    SELECT n.name, n.graph_no, n.node_no, (SELECT count(*) FROM orders WHERE 'k' || (o_custkey % 310) = n.name AND 'k' || (o_orderkey % 305) IN (SELECT name FROM n)) AS n_edges FROM n""",
)
def graph_merge(s, d):
    g = t.table(s, d, "customer").select(F.col("c_nationkey").alias("graph_no"), F.col("c_custkey").alias("node_no"), F.concat(F.lit("k"), (F.col("c_custkey") % 300).cast("string")).alias("name"))
    nodes = graph.merge_nodes(g)
    edges = t.table(s, d, "orders").select(F.concat(F.lit("k"), (F.col("o_custkey") % 310).cast("string")).alias("source"), F.concat(F.lit("k"), (F.col("o_orderkey") % 305).cast("string")).alias("target"))
    kept = graph.retain_edges(edges, nodes).groupBy(F.col("source").alias("e_name")).agg(F.count(F.lit(1)).alias("n"))
    return nodes.join(kept, nodes["name"] == kept["e_name"], "left").select("name", "graph_no", "node_no", F.coalesce("n", F.lit(0)).alias("n_edges"))


@query("count_by_kind", f"{_W} SELECT kind, count(*) AS n FROM symbols GROUP BY kind")
def count_by_kind(s, d):
    return summary.count_by_kind(t.symbols(s, d))


@query("key_types", "SELECT p_type AS name, count(*) AS n FROM part GROUP BY p_type ORDER BY n DESC, name LIMIT 10")
def key_types(s, d):
    return summary.key_types(t.table(s, d, "part").select(F.col("p_type").alias("name"), F.lit("Type").alias("kind")))


@query(
    "project_summary",
    f"""{_W}, f AS (SELECT count(*) AS n_files, count(*) FILTER (regexp_matches(lower(file_path), 'test|spec')) AS n_test_files, count(DISTINCT CASE WHEN NOT contains(string_split(file_path, '/')[1], '.') THEN string_split(file_path, '/')[1] END) AS n_modules FROM (SELECT DISTINCT file_path FROM symbols)),
    s AS (SELECT count(*) AS n_symbols, count(*) FILTER (kind IN ('Function', 'Method')) AS n_functions, count(*) FILTER (kind IN ('Function', 'Method') AND (regexp_matches(name, '^(test|it|should)_|_test$') OR coalesce(contains(doc_comment, '#[test]') OR contains(doc_comment, '@Test'), false))) AS n_test_functions, count(*) FILTER (kind IN ({_TYPES})) AS n_types FROM symbols),
    k AS (SELECT string_agg(name, ',' ORDER BY n DESC, name) AS key_types FROM (SELECT name, count(*) AS n FROM symbols WHERE kind IN ({_TYPES}) GROUP BY name ORDER BY n DESC, name LIMIT 10))
    SELECT * FROM f, s, k""",
)
def project_summary(s, d):
    symbols = t.symbols(s, d)
    return summary.project_summary(symbols.select("file_path"), symbols)


@query("changed_files", f"{_W}, c AS (SELECT file_path, count(*) AS n FROM symbols GROUP BY file_path), f AS (SELECT DISTINCT 'nation/' || n_nationkey || '.' || (['rs', 'py', 'ts', 'c'])[n_nationkey % 4 + 1] AS file_path, n_nationkey AS k FROM nation) SELECT f.file_path, CASE WHEN k % 3 = 0 THEN '?' ELSE '+' || k || '/-0' END AS changes, coalesce(n, 0) AS n_symbols FROM f LEFT JOIN c USING (file_path)")
def changed_files(s, d):
    n = t.table(s, d, "nation")
    path = F.concat(F.lit("nation/"), F.col("n_nationkey").cast("string"), F.lit("."), F.element_at(F.array(*[F.lit(x) for x in ("rs", "py", "ts", "c")]), (F.col("n_nationkey") % 4 + 1).cast("int")))
    files = n.select(path.alias("file_path"), F.col("n_nationkey").alias("k"))
    stats = files.where("k % 3 <> 0").select("file_path", F.concat(F.lit("+"), F.col("k").cast("string"), F.lit("/-0")).alias("changes"))
    return relate.changed_files(files, stats, t.symbols(s, d))


@query("diagnostics")
def diagnostics(s, d):
    return read.diagnostics(s)


@query("go_to_definition", f"{_C}, p AS (SELECT file_path, line_no, position('p_' IN text) + 1 AS col, regexp_extract(text, '(p_[0-9]+)', 1) AS identifier FROM call_lines), f AS (SELECT file_path, name, arg_min(seq, seq) AS definition, count(*) > 1 AS ambiguous FROM call_functions GROUP BY ALL) SELECT p.file_path, p.line_no AS line, p.identifier, CAST(f.definition AS VARCHAR) AS definition, f.ambiguous FROM p LEFT JOIN f ON f.file_path = p.file_path AND f.name = p.identifier")
def go_to_definition(s, d):
    lines = t.call_lines(s, d)
    at = lines.select("file_path", F.col("line_no").alias("line"), (F.instr("text", "p_") + 1).alias("column"))
    return relate.go_to_definition(at, lines, t.call_functions(s, d).withColumn("stable_id", F.col("seq").cast("string"))).drop("column")
