"""Catalogue queries over texts: lines, outlines, annotations, calls, edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, text
from ..operators import edit, outline, read, relate
from ..sources import files as src
from ..sources import toml
from . import tables as t

Q, O = {}, {}


def query(name: str, sql: str | None = None):
    def register(f):
        Q[name] = f
        if sql:
            O[name] = sql
        return f

    return register


_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_HEAD = "(t LIKE '# %' OR t LIKE '## %' OR t LIKE '### %')"
_COMMENT = f"(t LIKE '//%' OR t LIKE '/*%' OR t LIKE '*%' OR t LIKE '--%' OR t LIKE ';%' OR (t LIKE '#%' AND NOT {_HEAD}))"


def _chars(c: str, cls: str) -> str:
    return f"(length({c}) - length(regexp_replace({c}, '[{cls}]', '', 'g')))"


def _outline_sql(name: str) -> str:
    """CTEs of an outline over ``{name}_lines``."""
    declared = "^(" + "|".join(fixed.DECLARATIONS) + ")"
    return f"""
o_a AS (SELECT *, {_TRIM.format("text")} AS t FROM {name}_lines),
o_b AS (SELECT *, {_chars("t", r"{\[(")} AS opens, {_chars("t", r"}\])")} AS closes FROM o_a),
o_c AS (SELECT *, sum(opens - closes) OVER (PARTITION BY file_path ORDER BY line_no) AS s FROM o_b),
o_d AS (SELECT *, CAST(s - least(0, min(s) OVER (PARTITION BY file_path ORDER BY line_no)) AS INTEGER) AS depth_out FROM o_c),
o_e AS (SELECT *, lag(depth_out, 1, 0) OVER (PARTITION BY file_path ORDER BY line_no) AS depth_in, regexp_extract(text, '^(\\s*)', 1) AS lead,
  length(regexp_extract(t, '^([}})\\]]*)', 1)) AS closers FROM o_d),
o_f AS (SELECT *, CAST(ceil((length(lead) + 3 * (length(lead) - length(replace(lead, chr(9), '')))) / 4) AS INTEGER) AS indent FROM o_e),
o_g AS (SELECT *, CAST(indent + greatest(depth_in - closers, 0) AS INTEGER) AS depth, regexp_replace(t, '\\s+', '', 'g') AS u, regexp_matches(t, '[\\pL\\p{{Nl}}\\p{{M}}_]') AS ident FROM o_f),
o_h AS (SELECT *, t <> '' AND NOT {_COMMENT} AND (regexp_matches(lower(t), '{declared}') OR {_HEAD} OR ((t LIKE '%{{' OR t LIKE '%:') AND ident)
  OR ((indent = 0 OR depth <= 1) AND ident AND strlen(t) >= 4 AND u <> '' AND 20 * len(list_distinct(string_split(u, ''))) >= 9 * length(u))) AS structural FROM o_g),
o_i AS (SELECT *, max(line_no) OVER (PARTITION BY file_path) AS last_line, max(structural::INT) OVER (PARTITION BY file_path) AS any_s,
  min(CASE WHEN t <> '' THEN line_no END) OVER (PARTITION BY file_path) AS first_line FROM o_h),
o_j AS (SELECT file_path, line_no, CASE WHEN structural THEN depth ELSE 0 END AS depth, last_line, t FROM o_i WHERE structural OR (any_s = 0 AND line_no = first_line)),
o_k AS (SELECT a.file_path, a.line_no, a.depth, any_value(a.t) AS t, greatest(coalesce(min(b.line_no) - 1, any_value(a.last_line)), a.line_no) AS line_end
  FROM o_j a LEFT JOIN o_j b ON a.file_path = b.file_path AND b.line_no > a.line_no AND b.depth <= a.depth GROUP BY a.file_path, a.line_no, a.depth),
outline AS (SELECT file_path, 'region-' || (line_no + 1) AS region_id, CAST(line_no + 1 AS INTEGER) AS line, CAST(line_end + 1 AS INTEGER) AS line_end, depth, t,
  CASE WHEN length(t) > 80 THEN left(t, 80) || '...' ELSE t END AS label FROM o_k)"""


@query("lines_scan", f"WITH {t.DOC} SELECT * FROM doc_lines")
def lines_scan(s, d):
    return t.doc_lines(s, d)


@query("bracket_depth", f"WITH {t.PAGE}, {_outline_sql('page')} SELECT file_path, line_no, depth_in, depth_out FROM o_e")
def bracket_depth(s, d):
    return outline.bracket_depths(t.page_lines(s, d)).select("file_path", "line_no", "depth_in", "depth_out")


@query("effective_depth", f"WITH {t.PAGE}, {_outline_sql('page')} SELECT file_path, line_no, indent, depth FROM o_g")
def effective_depth(s, d):
    return outline.effective_depths(t.page_lines(s, d)).select("file_path", "line_no", "indent", "depth")


@query("line_entropy", f"WITH {t.DOC}, {_outline_sql('doc')} SELECT file_path, line_no, u <> '' AND 20 * len(list_distinct(string_split(u, ''))) >= 9 * length(u) AS varied FROM o_g")
def line_entropy(s, d):
    return t.doc_lines(s, d).select("file_path", "line_no", text.varied(text.trim(F.col("text"))).alias("varied"))


@query("structural_lines", f"WITH {t.DOC}, {_outline_sql('doc')} SELECT file_path, line_no, depth, structural FROM o_h")
def structural_lines(s, d):
    return outline.structural_lines(t.doc_lines(s, d)).select("file_path", "line_no", "depth", "structural")


_FNV = f"""
WITH RECURSIVE {{lines}}, {{outline}},
b AS (SELECT file_path, line, line_end, depth, label, t, 1 AS i, {fixed.FNV_OFFSET}::HUGEINT AS h, hex(encode(t)) AS x FROM outline),
fold AS (SELECT * FROM b UNION ALL SELECT file_path, line, line_end, depth, label, t, i + 2,
  ((h - h % 256 + xor((h % 256)::BIGINT, ('0x' || substring(x, i, 2))::BIGINT)) * {fixed.FNV_PRIME}::HUGEINT) % 18446744073709551616::HUGEINT, x FROM fold WHERE i < length(x))
SELECT file_path, 'h-' || lower(lpad(hex(h::UBIGINT), 16, '0')) || '-' || line AS region_id, line, line_end, depth, label FROM fold WHERE i > length(x)"""


@query("heuristic_outline", f"WITH {t.DOC}, {_outline_sql('doc')} SELECT file_path, line, line_end, depth, label FROM outline")
def heuristic_outline(s, d):
    return outline.outline(t.doc_lines(s, d), hashed=False).drop("region_id")


@query("page_outline", f"WITH {t.PAGE}, {_outline_sql('page')} SELECT file_path, region_id, line, line_end, depth, label FROM outline")
def page_outline(s, d):
    return outline.outline(t.page_lines(s, d), hashed=False)


@query("parserless_outline", f"WITH {t.TALK}, {_outline_sql('talk')} SELECT file_path, region_id, line, line_end, depth, label FROM outline")
def parserless_outline(s, d):
    return outline.outline(explode(t.talk_files(s, d)), hashed=False)


def explode(files):
    return src.explode_lines(files)


@query("region_ids_fnv", _FNV.format(lines=t.TALK, outline=_outline_sql("talk").replace("{", "{{").replace("}", "}}")).replace("{{", "{").replace("}}", "}"))
def region_ids_fnv(s, d):
    return outline.outline(explode(t.talk_files(s, d)))


@query("region_text", f"WITH {t.DOC}, {_outline_sql('doc')} SELECT o.file_path, region_id, array_to_string((string_split(source, chr(10)))[line:o.line_end], chr(10)) || CASE WHEN o.line_end < len(string_split(source, chr(10))) THEN chr(10) ELSE '' END AS body FROM outline o JOIN doc_files f USING (file_path)")
def region_text(s, d):
    return outline.region_text(t.doc_files(s, d), outline.outline(t.doc_lines(s, d), hashed=False))


@query("outline_symbols", f"WITH {t.TALK}, {_outline_sql('talk')} SELECT file_path, label AS name, 'Module' AS kind, CAST(line - 1 AS INTEGER) AS line_start, CAST(line_end - 1 AS INTEGER) AS line_end, region_id || ' [parserless]' AS signature FROM outline")
def outline_symbols(s, d):
    return outline.outline_symbols(outline.outline(explode(t.talk_files(s, d)), hashed=False), "parserless")


@query("compact_label", f"WITH {t.DOC} SELECT file_path, line_no, CASE WHEN length(text) > 80 THEN left(text, 80) || '...' ELSE text END AS label FROM doc_lines")
def compact_label(s, d):
    return t.doc_lines(s, d).select("file_path", "line_no", text.compact_label(F.col("text")).alias("label"))


_TOML = "'[' || c_mktsegment || ']' || chr(10) || 'name = 1' || chr(10) || CASE WHEN c_custkey % 3 = 0 THEN '[[ a.' || c_nationkey || ' ]]' || chr(10) || 'x = [1]' ELSE 'y = 2' END || chr(10) || '[end]' || chr(10)"
_TOML_LINES = t._lines_sql("toml", "'c/' || c_custkey || '.toml'", _TOML, "customer")


@query(
    "toml_regions",
    f"""WITH {_TOML_LINES},
    h AS (SELECT *, {_TRIM.format("regexp_extract(" + _TRIM.format("text") + r", '^\[+([^\[\]]+)\]+$', 1)")} AS name, max(line_no) OVER (PARTITION BY file_path) AS last FROM toml_lines)
    SELECT file_path, name, 'table:' || name AS region_id, CAST(line_no + 1 AS INTEGER) AS line, CAST(coalesce(lead(line_no) OVER (PARTITION BY file_path ORDER BY line_no), last + 1) AS INTEGER) AS line_end FROM h WHERE name <> ''""",
)
def toml_regions(s, d):
    c = t.table(s, d, "customer")
    extra = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("[[ a."), F.col("c_nationkey").cast("string"), F.lit(" ]]\nx = [1]"))).otherwise("y = 2")
    files = c.select(F.concat(F.lit("c/"), F.col("c_custkey").cast("string"), F.lit(".toml")).alias("file_path"), F.concat(F.lit("["), "c_mktsegment", F.lit("]\nname = 1\n"), extra, F.lit("\n[end]\n")).alias("source"))
    return toml.toml_regions(explode(files))


_DIFF_SQL = r"""
diffs AS (SELECT o_orderkey AS diff_id, 'diff --git a/f b/f' || chr(10) || '--- a/f' || chr(10) || '+++ b/nation/' || (o_custkey % 25) || '.' || (['rs', 'py', 'ts', 'go', 'java'])[o_custkey % 25 % 5 + 1] || chr(10)
  || '@@ -1,2 +' || (o_orderkey % 90 + 1) || ',' || (o_orderkey % 4) || ' @@ fn' || chr(10) || '+x' || chr(10) || '@@ -9 +' || (o_orderkey % 50 + 1) || ' @@' || chr(10) || '+y' || CASE WHEN o_orderkey % 5 = 0 THEN chr(10) || '+++ b/gone.rs' || chr(10) || '@@ -1 +3,2 @@' ELSE '' END AS diff FROM orders),
d_rows AS (SELECT diff_id, i, p[i] AS text FROM (SELECT diff_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT diff_id, string_split(diff, chr(10)) AS p FROM diffs))),
d_file AS (SELECT *, last_value(CASE WHEN text LIKE '+++ b/%' THEN substring(text, 7) END IGNORE NULLS) OVER (PARTITION BY diff_id ORDER BY i) AS file_path FROM d_rows),
d_hunk AS (SELECT *, CAST(regexp_extract(text, '^@@ -\S+ \+(\d+)(?:,(\d+))? @@', 1) AS INTEGER) - 1 AS first, regexp_extract(text, '^@@ -\S+ \+(\d+)(?:,(\d+))? @@', 2) AS n FROM d_file WHERE regexp_matches(text, '^@@ -\S+ \+(\d+)(?:,(\d+))? @@')),
diff_lines AS (SELECT diff_id, file_path, CAST(unnest(range(first, first + CASE WHEN n = '' THEN 1 ELSE CAST(n AS INTEGER) END)) AS INTEGER) AS line_no FROM d_hunk)"""


def diffs(s, d):
    o = t.table(s, d, "orders")
    k, f = F.col("o_orderkey"), F.col("o_custkey") % 25
    ext = F.element_at(F.array(*[F.lit(x) for x in ("rs", "py", "ts", "go", "java")]), (f % 5 + 1).cast("int"))
    st = lambda c: c.cast("string")
    diff = F.concat(
        F.lit("diff --git a/f b/f\n--- a/f\n+++ b/nation/"), st(f), F.lit("."), ext, F.lit("\n@@ -1,2 +"), st(k % 90 + 1), F.lit(","), st(k % 4), F.lit(" @@ fn\n+x\n@@ -9 +"), st(k % 50 + 1), F.lit(" @@\n+y"),
        F.when(k % 5 == 0, "\n+++ b/gone.rs\n@@ -1 +3,2 @@").otherwise(""),
    )
    return o.select(k.alias("diff_id"), diff.alias("diff"))


@query("diff_hunks", f"WITH {_DIFF_SQL} SELECT * FROM diff_lines")
def diff_hunks(s, d):
    return src.diff_lines(diffs(s, d))


@query("diff_stat", "SELECT 'src/' || o_custkey || '.rs' AS file_path, '+' || (o_orderkey % 9) || '/-' || (o_custkey % 7) AS changes FROM orders")
def diff_stat(s, d):
    o = t.table(s, d, "orders")
    line = F.concat(F.lit(" src/"), F.col("o_custkey").cast("string"), F.lit(".rs | 12 "), F.repeat(F.lit("+"), (F.col("o_orderkey") % 9).cast("int")), F.repeat(F.lit("-"), (F.col("o_custkey") % 7).cast("int")))
    return src.diff_stat(o.select(line.alias("text"))).select("file_path", "changes")


@query("diff_symbols", f"""WITH {_DIFF_SQL}, {t.SYMBOLS},
c AS (SELECT DISTINCT file_path, line_no FROM diff_lines), here AS (SELECT DISTINCT file_path FROM symbols),
met AS (SELECT c.file_path, stable_id, kind, row_number() OVER (PARTITION BY c.file_path, c.line_no ORDER BY line_end - line_start, seq) AS r FROM c JOIN symbols s ON s.file_path = c.file_path AND c.line_no BETWEEN line_start AND line_end)
SELECT DISTINCT file_path, stable_id, kind, NULL::INTEGER AS line_no FROM met WHERE r = 1
UNION ALL SELECT file_path, '(deleted)', NULL, line_no FROM c WHERE file_path NOT IN (SELECT file_path FROM here)""")
def diff_symbols(s, d):
    symbols = t.symbols(s, d)
    return relate.diff_symbols(src.diff_lines(diffs(s, d)), symbols, symbols.select("file_path").distinct())


_TESTS_SQL = f"WITH {t.DOC}, m AS (SELECT *, ({_TRIM.format('text')} LIKE 'The%')::INT AS hit FROM doc_lines) SELECT file_path, line_no, coalesce(max(hit) OVER (PARTITION BY file_path ORDER BY line_no ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0) = 1 AS marked FROM m"


@query("marked_above", _TESTS_SQL)
def marked_above(s, d):
    return read.marked_above(t.doc_lines(s, d), "The").select("file_path", "line_no", "marked")


_TAGS = ["license", "copyright", "the", "MIT"]


@query("annotations", f"""WITH {t.DOC}, g AS (SELECT *, CASE {" ".join(f"WHEN regexp_matches(text, '(?i){g}') THEN '{g}'" for g in _TAGS)} END AS tag FROM doc_lines),
r AS (SELECT *, CASE tag {" ".join(f"WHEN '{g}' THEN regexp_extract(text, '(?i){g}(.*)$', 1)" for g in _TAGS)} END AS rest FROM g WHERE tag IS NOT NULL)
SELECT file_path, line_no, tag, {_TRIM.format("regexp_replace(regexp_replace(rest, '^[: \\]]+', ''), '[*/]+$', '')")} AS message FROM r""")
def annotations(s, d):
    return read.annotations(t.doc_lines(s, d), _TAGS)


def _calls_sql(name: str) -> str:
    words = ", ".join(f"'{w}'" for w in fixed.CALL_KEYWORDS)
    return f"""c AS (SELECT file_path, line_no, regexp_extract_all(text, '([\\pL\\pN_]+) *\\(', 1) AS names FROM {name}_lines WHERE NOT ({_TRIM.format("text")} LIKE '//%' OR {_TRIM.format("text")} LIKE '#%')),
calls AS (SELECT file_path, line_no, CAST(i - 1 AS INTEGER) AS n, names[i] AS name FROM (SELECT *, unnest(range(1, len(names) + 1)) AS i FROM c) WHERE names[i] NOT IN ({words}))"""


@query("call_sites", f"WITH {t.DOC}, {_calls_sql('doc')} SELECT * FROM calls")
def call_sites(s, d):
    return read.call_sites(t.doc_lines(s, d))


@query("call_sites_pages", f"WITH {t.PAGE}, {_calls_sql('page')} SELECT * FROM calls")
def call_sites_pages(s, d):
    return read.call_sites(t.page_lines(s, d))


@query("identifier_at", rf"""WITH {t.DOC}, p AS (SELECT *, (line_no * 7 + 3) % 40 AS col FROM doc_lines),
q AS (SELECT *, list_filter(range(0, least(col, length(text)) + 1), lambda n: strlen(left(text, CAST(n AS INTEGER))) = col)[1] AS c FROM p)
SELECT file_path, line_no, CASE WHEN col < strlen(text) AND c IS NOT NULL AND regexp_matches(substring(text, c + 1), '^[\pL\pN_]') THEN regexp_extract(left(text, c), '([\pL\pN_]*)$', 1) || regexp_extract(substring(text, c + 1), '^([\pL\pN_]+)', 1) END AS identifier FROM q""")
def identifier_at(s, d):
    return t.doc_lines(s, d).select("file_path", "line_no", text.identifier_at(F.col("text"), (F.col("line_no") * 7 + 3) % 40).alias("identifier"))


@query("find_references", r"""WITH """ + t.DOC + r""", w AS (SELECT file_path, line_no, unnest(regexp_extract_all(text, '([\pL_][\pL\pN_]*)', 1)) AS x FROM doc_lines),
first AS (SELECT file_path, regexp_extract(text, '([A-Za-z_]\w*)', 1) AS target FROM doc_lines WHERE line_no = 0)
SELECT w.file_path, f.target, w.line_no, count(*) AS n FROM w JOIN first f ON f.file_path = w.file_path AND f.target = w.x GROUP BY ALL""")
def find_references(s, d):
    refs = relate.find_references(_targets(s, d), t.doc_lines(s, d))
    return refs.groupBy("file_path", "target", "line_no").agg(F.count(F.lit(1)).alias("n"))


def _targets(s, d):
    """The first ASCII identifier of the first line of each text."""
    return t.doc_lines(s, d).where("line_no = 0").select("file_path", F.regexp_extract("text", r"([A-Za-z_]\w*)", 1).alias("text"))


_COMPLEX = " + ".join(f"(length(t) - length(replace(t, '{k}', ''))) // {len(k)}" for k in fixed.BRANCHES)


@query("complexity", f"""WITH {t.DOC}, x AS (SELECT file_path, {_TRIM.format("text")} AS t FROM doc_lines), y AS (SELECT file_path, CASE WHEN t LIKE '//%' OR t LIKE '#%' OR t LIKE '/*%' THEN 0 ELSE {_COMPLEX} END AS n FROM x),
z AS (SELECT file_path, CAST(1 + sum(n) AS BIGINT) AS complexity FROM y GROUP BY file_path)
SELECT *, CASE WHEN complexity <= 5 THEN 'simple' WHEN complexity <= 10 THEN 'moderate' WHEN complexity <= 20 THEN 'complex' ELSE 'very complex' END AS rating FROM z""")
def complexity(s, d):
    per = t.doc_lines(s, d).groupBy("file_path").agg((F.sum(text.complexity_of(F.col("text"))) + 1).alias("complexity"))
    return per.withColumn("rating", text.complexity_rating(F.col("complexity")))


@query("graph_skeleton", r"SELECT doc_id, coalesce(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '\S'))[1], '') AS description FROM documents")
def graph_skeleton(s, d):
    return t.table(s, d, "documents").select("doc_id", text.skeleton(F.coalesce("text", F.lit(""))).alias("description"))


@query("utf16_offset", f"""WITH {t.DOC}, p AS (SELECT file_path, line_no, text, (line_no * 5 + 2) % 30 AS col FROM doc_lines),
c AS (SELECT *, unnest(range(0, length(text) + 1)) AS i FROM p), e AS (SELECT *, left(text, i) AS h FROM c WHERE i <= 30),
f AS (SELECT *, length(h) + length(regexp_replace(h, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) AS units FROM e)
SELECT p.file_path, p.line_no, CAST(min(strlen(f.h)) AS INTEGER) AS byte_offset FROM p LEFT JOIN f ON f.file_path = p.file_path AND f.line_no = p.line_no AND f.units = p.col GROUP BY p.file_path, p.line_no""")
def utf16_offset(s, d):
    return t.doc_lines(s, d).select("file_path", "line_no", text.utf16_offset(F.col("text"), (F.col("line_no") * 5 + 2) % 30).alias("byte_offset"))


def _edits(s, d):
    last = t.doc_lines(s, d).groupBy("file_path").agg(F.max("line_no").alias("last"))
    return last.where("last >= 3").select("file_path", F.lit(2).alias("start_line"), F.lit(3).alias("end_line"), F.lit(2).alias("line"), F.lit("new one\nnew two\nnew three").alias("content"))


_OLD = f"WITH {t.DOC}, e AS (SELECT file_path FROM doc_lines GROUP BY file_path HAVING max(line_no) >= 3), n AS (SELECT file_path, {{at}} AS major, i AS minor, ('new ' || (['one', 'two', 'three'])[i + 1]) AS text FROM e, range(0, 3) r(i)), "
_RENUM = "SELECT file_path, CAST(row_number() OVER (PARTITION BY file_path ORDER BY major, minor) - 1 AS INTEGER) AS line_no, text FROM u"


@query("replace_lines", _OLD.format(at="1.0") + f"u AS (SELECT file_path, line_no::DOUBLE AS major, 0 AS minor, text FROM doc_lines WHERE NOT (line_no IN (1, 2) AND file_path IN (SELECT file_path FROM e)) UNION ALL SELECT * FROM n) {_RENUM}")
def replace_lines(s, d):
    return edit.replace_lines(t.doc_lines(s, d), _edits(s, d))


@query("insert_lines", _OLD.format(at="0.5") + f"u AS (SELECT file_path, line_no::DOUBLE AS major, 0 AS minor, text FROM doc_lines UNION ALL SELECT * FROM n) {_RENUM}")
def insert_lines(s, d):
    return edit.insert_at_line(t.doc_lines(s, d), _edits(s, d))


@query("delete_lines", _OLD.format(at="0.0") + f"u AS (SELECT file_path, line_no::DOUBLE AS major, 0 AS minor, text FROM doc_lines WHERE NOT (line_no IN (1, 2) AND file_path IN (SELECT file_path FROM e))) {_RENUM}")
def delete_lines(s, d):
    return edit.delete_lines(t.doc_lines(s, d), _edits(s, d))


def _regions(s, d):
    """A symbol a region of the outline: the first word of its label."""
    r = outline.outline(t.doc_lines(s, d), hashed=False)
    return r.select("file_path", F.regexp_extract("label", r"(\w+)", 1).alias("name"), (F.col("line") - 1).alias("line_start"), (F.col("line_end") - 1).alias("line_end"), F.col("line").alias("seq"))


_MOVE = f"""WITH {t.DOC}, {_outline_sql('doc')}, sy AS (SELECT file_path, regexp_extract(label, '(\\w+)', 1) AS name, line - 1 AS a, line_end - 1 AS z, line AS seq FROM outline),
fs AS (SELECT file_path, min(seq) AS q FROM sy GROUP BY file_path), tg AS (SELECT s.file_path, s.name, f.q FROM sy s JOIN fs f ON s.file_path = f.file_path AND s.seq = f.q),
sp AS (SELECT t.file_path, arg_min(s.a, s.seq) AS a, arg_min(s.z, s.seq) AS z FROM tg t JOIN sy s ON s.file_path = t.file_path AND s.name = t.name GROUP BY t.file_path)"""


@query("insert_after_symbol", _MOVE + f", u AS (SELECT file_path, line_no::DOUBLE AS major, 0 AS minor, text FROM doc_lines UNION ALL SELECT file_path, z + 0.5, i, (['', 'added'])[i + 1] FROM sp, range(0, 2) r(i)) {_RENUM}")
def insert_after_symbol(s, d):
    symbols = _regions(s, d)
    first = symbols.groupBy("file_path").agg(F.min_by("name", "seq").alias("symbol")).withColumn("content", F.lit("added"))
    return edit.insert_after_symbol(t.doc_lines(s, d), symbols, first)


@query("replace_symbol_body", _MOVE + f", u AS (SELECT l.file_path, line_no::DOUBLE AS major, 0 AS minor, text FROM doc_lines l LEFT JOIN sp ON sp.file_path = l.file_path WHERE sp.a IS NULL OR line_no < a OR line_no > z UNION ALL SELECT file_path, a, 0, 'body' FROM sp) {_RENUM}")
def replace_symbol_body(s, d):
    symbols = _regions(s, d)
    first = symbols.groupBy("file_path").agg(F.min_by("name", "seq").alias("symbol")).withColumn("content", F.lit("body"))
    return edit.replace_symbol_body(t.doc_lines(s, d), symbols, first)


@query("workspace_edit", """WITH f AS (SELECT 'doc/' || doc_id AS file_path, coalesce(text, '') AS source, length(coalesce(text, '')) AS n, doc_id FROM documents),
e AS (SELECT file_path, source, 1 AS a, 4 AS b, 'XX' AS x, doc_id % 5 = 0 AS bad FROM f WHERE n > 20)
SELECT f.file_path, CASE WHEN n > 20 AND doc_id % 5 <> 0 THEN left(source, 1) || 'XX' || substring(source, 5, 6) || 'Y' || substring(source, 11) ELSE source END AS source FROM f""")
def workspace_edit(s, d):
    docs = t.table(s, d, "documents")
    files = docs.select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("file_path"), F.coalesce("text", F.lit("")).alias("source"), "doc_id")
    big = files.where(F.length("source") > 20)
    one = big.select("file_path", F.lit(1).alias("start"), F.lit(4).alias("end"), F.lit("XX").alias("new_text"))
    two = big.select("file_path", F.when(F.col("doc_id") % 5 == 0, 3).otherwise(10).alias("start"), F.lit(10).alias("end"), F.lit("Y").alias("new_text"))
    return edit.apply_edits(files.select("file_path", "source"), one.unionByName(two))


@query("edit_preview", "SELECT count(*) AS n_edits, count(DISTINCT l_orderkey) AS n_files, count(DISTINCT l_suppkey) AS n_groups FROM lineitem")
def edit_preview(s, d):
    return edit.preview(t.table(s, d, "lineitem").select(F.col("l_orderkey").alias("file_path"), F.col("l_suppkey").alias("group_id")))
