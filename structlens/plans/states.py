"""Catalogue queries over paths, configurations, versions and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, text
from ..operators import config, incremental, summary
from ..sources import files as src
from ..streaming import index
from . import tables as t

Q, O = {}, {}


def query(name: str, sql: str | None = None):
    def register(f):
        Q[name] = f
        if sql:
            O[name] = sql
        return f

    return register


_EXT = r"regexp_extract(path, '[^/]\.([^./]+)$', 1)"
_LANG = "(VALUES " + ", ".join(f"('{e}', '{lang}')" for lang, es in fixed.EXTENSIONS.items() for e in es) + ") lang(ext, language)"
_IN = lambda names: ", ".join(f"'{n}'" for n in names)
_NAME = "regexp_extract(lower(path), '([^/]*)$', 1)"
_SURFACE = rf"""CASE WHEN {_NAME} IN ({_IN(fixed.BUILD_FILES)}) THEN 'Build'
  WHEN contains(lower(path), '/docs/') OR contains(lower(path), '/doc/') OR {_NAME} IN ({_IN(fixed.DOC_FILES)}) OR {_EXT.replace("path", "lower(path)")} IN ({_IN(fixed.DOC_EXTENSIONS)}) THEN 'Documentation'
  WHEN {_NAME} IN ({_IN(fixed.MANIFESTS)}) OR {_EXT.replace("path", "lower(path)")} IN ({_IN(fixed.CONFIG_EXTENSIONS)}) OR contains(lower(path), '/config/') OR contains(lower(path), '/configs/') OR contains(lower(path), '/manifest') THEN 'Configuration' END"""
_P = f"WITH {t.PATHS}"


@query("files_by_language", f"{_P} SELECT language, count(*) AS n_files FROM paths JOIN {_LANG} ON ext = {_EXT} GROUP BY language")
def files_by_language(s, d):
    return summary.files_by_language(src.with_language(t.paths(s, d), s, "path"))


@query("language_alias", f"""SELECT c_custkey AS k, CASE lower(n) {" ".join(f"WHEN '{a}' THEN '{lang}'" for a, lang in [*((x, x) for x in fixed.EXTENSIONS), *fixed.ALIASES.items()])} END AS language FROM (SELECT c_custkey, (['Rust', 'PY', 'c++', 'Golang', 'kt', 'nope', 'F#'])[c_custkey % 7 + 1] AS n FROM customer)""")
def language_alias(s, d):
    names = F.element_at(F.array(*[F.lit(x) for x in ("Rust", "PY", "c++", "Golang", "kt", "nope", "F#")]), (F.col("c_custkey") % 7 + 1).cast("int"))
    return src.resolve_alias(t.table(s, d, "customer").select(F.col("c_custkey").alias("k"), names.alias("name")), s).select("k", "language")


@query(
    "root_detection",
    """WITH f AS (SELECT 'w' || (p_partkey % 5) || '/a' || (p_partkey % 7) || '/b/f' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '.rs' ELSE '.py' END AS file_path, p_partkey AS k FROM part),
    m AS (SELECT file_path, k, k % 2 = 0 AS rust, 'w' || (k % 5) AS d1, 'w' || (k % 5) || '/a' || (k % 7) AS d2 FROM f)
    SELECT file_path, CASE WHEN rust THEN 'rust' ELSE 'python' END AS language,
      CASE WHEN rust AND k % 5 = 0 THEN d1 WHEN rust AND k % 7 < 3 THEN d2 WHEN rust AND k % 5 = 1 THEN d1 WHEN NOT rust AND k % 7 >= 5 THEN d2 WHEN NOT rust AND k % 5 = 3 THEN d1 WHEN k % 5 = 4 THEN d1 ELSE '' END AS root FROM m""",
)
def root_detection(s, d):
    k = F.col("p_partkey")
    st = lambda c: c.cast("string")
    path = F.concat(F.lit("w"), st(k % 5), F.lit("/a"), st(k % 7), F.lit("/b/f"), st(k), F.when(k % 2 == 0, ".rs").otherwise(".py"))
    files = t.table(s, d, "part").select(path.alias("file_path"), F.when(k % 2 == 0, "rust").otherwise("python").alias("language"))
    there = [f"w{a}/Cargo.toml" for a in (0, 1)] + [f"w{a}/a{b}/Cargo.toml" for a in range(5) for b in (0, 1, 2)] + [f"w{a}/a{b}/setup.py" for a in range(5) for b in (5, 6)] + ["w3/pyproject.toml", "w4/.git"]
    return src.detect_roots(files, s.createDataFrame([(p, p == "w0/Cargo.toml") for p in there], "path string, workspace boolean"), s)


@query("module_summary", f"{_P}, f AS (SELECT DISTINCT path FROM paths), s AS (SELECT path, count(*) AS n FROM paths WHERE part_id % 3 = 0 GROUP BY path), m AS (SELECT string_split(path, '/')[1] AS module, n FROM f LEFT JOIN s USING (path)) SELECT module, count(*) AS n_files, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_functions FROM m WHERE NOT contains(module, '.') GROUP BY module")
def module_summary(s, d):
    p = t.paths(s, d).withColumnRenamed("path", "file_path")
    return summary.module_summary(p, p.where("part_id % 3 = 0").withColumn("kind", F.lit("Function")))


_ENTRY = "CASE regexp_extract(path, '([^/]*)$', 1) " + " ".join(f"WHEN '{n}' THEN '{k}'" for n, k in fixed.ENTRY_FILES.items()) + " END"


@query("entry_points", f"{_P}, m AS (SELECT path, max((part_id % 50 = 0)::INT) AS main FROM paths GROUP BY path), k AS (SELECT path AS file_path, CASE WHEN main = 1 THEN 'main()' ELSE {_ENTRY} END AS kind FROM m) SELECT * FROM k WHERE kind IS NOT NULL")
def entry_points(s, d):
    p = t.paths(s, d).withColumnRenamed("path", "file_path")
    return summary.entry_points(p, p.where("part_id % 50 = 0").withColumns({"name": F.lit("main"), "kind": F.lit("Function")}))


@query("repo_surfaces", f"{_P}, c AS (SELECT path, {_SURFACE} AS surface FROM paths), r AS (SELECT surface, path, row_number() OVER (PARTITION BY surface ORDER BY path) AS i FROM (SELECT DISTINCT surface, path FROM c)) SELECT c.surface, count(*) AS n, (SELECT string_agg(path, chr(10) ORDER BY path) FROM r WHERE r.surface = c.surface AND i <= 12) AS samples FROM c WHERE c.surface IS NOT NULL GROUP BY c.surface")
def repo_surfaces(s, d):
    return summary.surfaces(t.paths(s, d))


@query("test_file_predicates", f"{_P} SELECT part_id, contains(path, '/test') OR contains(path, '_test') OR regexp_matches(path, '(^|/)tests(/|$)') AS strict, regexp_matches(lower(path), 'test|spec') AS lax FROM paths")
def test_file_predicates(s, d):
    return t.paths(s, d).select("part_id", text.is_test_path(F.col("path")).alias("strict"), text.mentions_test(F.col("path")).alias("lax"))


@query("sanitize_path", r"SELECT page_id, CASE WHEN starts_with(p, '/w/site' || (page_id % 3) || '/') THEN substring(p, length('/w/site' || (page_id % 3)) + 2) WHEN starts_with(p, '/') THEN regexp_extract(p, '([^/]*)$', 1) ELSE p END AS path FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'rel\' || url WHEN 1 THEN '/elsewhere/x' || page_id ELSE '/w/site' || (page_id % 3) || '/a/b' || page_id END AS q, replace(q, '\', '/') AS p FROM pages)")
def sanitize_path(s, d):
    k = F.col("page_id")
    root = F.concat(F.lit("/w/site"), (k % 3).cast("string"))
    path = F.when(k % 4 == 0, F.concat(F.lit("rel\\"), "url")).when(k % 4 == 1, F.concat(F.lit("/elsewhere/x"), k.cast("string"))).otherwise(F.concat(root, F.lit("/a/b"), k.cast("string")))
    return t.table(s, d, "pages").select("page_id", text.sanitize_path(path, root).alias("path"))


@query("worktree_ids", r"SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN 'main' WHEN 1 THEN 'feature' || c_nationkey ELSE '/srv/bare' END AS worktree, c_custkey % 4 <> 0 AS valid FROM customer")
def worktree_ids(s, d):
    k = F.col("c_custkey")
    git = F.when(k % 3 == 0, "/a/.git").when(k % 3 == 1, F.concat(F.lit("/a/.git/worktrees/feature"), F.col("c_nationkey").cast("string"))).otherwise("/srv/bare")
    ref = F.when(k % 4 == 0, "bad;ref").otherwise("origin/main~2")
    return t.table(s, d, "customer").select(k.alias("k"), text.worktree_id(git).alias("worktree"), text.valid_git_ref(ref).alias("valid"))


@query("severities", "SELECT event_id, CASE event_id % 6 WHEN 1 THEN 'Error' WHEN 3 THEN 'Information' WHEN 4 THEN 'Hint' ELSE 'Warning' END AS severity FROM events")
def severities(s, d):
    return t.table(s, d, "events").select("event_id", text.severity(F.col("event_id") % 6).alias("severity"))


@query("fingerprints", "WITH e AS (SELECT user_id, CAST(date_trunc('day', ts) AS DATE) AS day, list_sort(list_distinct(list(event_type) FILTER (value > 50))) AS x, list_sort(list_distinct(list(event_type) FILTER (NOT value > 50))) AS m FROM events GROUP BY ALL) SELECT user_id, CAST(day AS VARCHAR) AS day, array_to_string(list_concat(list_transform(coalesce(x, []), lambda v: 'e:' || v), list_transform(coalesce(m, []), lambda v: 'i:' || v)), ',') AS signature FROM e")
def fingerprints(s, d):
    e = t.table(s, d, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.when(F.col("value") > 50, "export").otherwise("import").alias("direction"), F.col("event_type").alias("name"))
    return incremental.fingerprints(e, ["user_id", "day"])


@query(
    "classify_change",
    f"""WITH {t.VERSIONS}, l AS (SELECT *, lag(signature_hash) OVER w AS s0, lag(content_hash) OVER w AS c0, row_number() OVER w AS nth FROM versions WINDOW w AS (PARTITION BY path ORDER BY ts, event_id))
    SELECT path, event_id, CASE WHEN nth = 1 THEN 'FullUpdate' WHEN content_hash IS NOT DISTINCT FROM c0 THEN 'Skip' WHEN signature_hash IS NOT DISTINCT FROM s0 THEN 'PartialUpdate' ELSE 'ArchitectureUpdate' END AS change FROM l""",
)
def classify_change(s, d):
    return incremental.classify_changes(t.versions(s, d)).select("path", "event_id", "change")


def _days(s, d):
    e = t.table(s, d, "events").select(F.concat(F.lit("u/"), F.col("user_id").cast("string")).alias("path"), "ts", "event_id", F.floor("value").alias("size"), F.dayofmonth("ts").alias("day"))
    last = lambda rows: rows.groupBy("path").agg(F.max("day").cast("long").alias("mtime"), F.max_by("size", F.struct("ts", "event_id")).alias("size"))
    return last(e.where("day < 15")), last(e.where("day < 17 AND event_id % 10 <> 0"))


_DAYS = """e AS (SELECT 'u/' || user_id AS path, ts, event_id, CAST(floor(value) AS BIGINT) AS size, day(ts) AS day FROM events),
old AS (SELECT path, max(day) AS mtime, arg_max(size, (ts, event_id)) AS size FROM e WHERE day < 15 GROUP BY path),
new AS (SELECT path, max(day) AS mtime, arg_max(size, (ts, event_id)) AS size FROM e WHERE day < 17 AND event_id % 10 <> 0 GROUP BY path)"""


@query("stale_and_deleted", f"WITH {_DAYS} SELECT coalesce(n.path, o.path) AS path, CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'deleted' WHEN n.mtime = o.mtime AND n.size = o.size THEN 'fresh' ELSE 'stale' END AS status FROM new n FULL JOIN old o ON n.path = o.path")
def stale_and_deleted(s, d):
    return incremental.diff_listing(*_days(s, d))


@query("cache_upsert", f"WITH {_DAYS} SELECT path, mtime, size FROM old WHERE path NOT IN (SELECT path FROM new WHERE size % 2 = 0) UNION ALL SELECT path, mtime, size FROM new WHERE size % 2 = 0")
def cache_upsert(s, d):
    old, new = _days(s, d)
    return incremental.cache_upsert(old, new.where("size % 2 = 0"), prune=False)


@query("index_refresh", f"WITH {_DAYS}, st AS (SELECT n.path, n.size FROM new n LEFT JOIN old o ON n.path = o.path WHERE o.path IS NULL OR NOT (n.mtime = o.mtime AND n.size = o.size)) SELECT o.path AS file_path, 'old' AS origin FROM old o JOIN new n ON n.path = o.path AND n.mtime = o.mtime AND n.size = o.size UNION ALL SELECT path, 'new' FROM st")
def index_refresh(s, d):
    cache, listing = _days(s, d)
    index_, _ = incremental.refresh(cache.select(F.col("path").alias("file_path"), F.lit("old").alias("origin")), cache, listing, lambda todo: todo.select(F.col("path").alias("file_path"), F.lit("new").alias("origin")))
    return index_


_RUNS = "runs AS (SELECT user_id, count(*) FILTER (event_type = 'purchase' AND user_id % 4 <> 0) AS processed, count(*) FILTER (event_type = 'view' AND user_id % 3 <> 0) AS cached, count(*) FILTER (event_type = 'error' AND user_id % 5 <> 0) AS failed FROM events GROUP BY user_id)"


@query(
    "export_status",
    f"""WITH {_RUNS}, s AS (SELECT *, processed + cached + failed AS supported FROM runs), o AS (SELECT *, CASE WHEN supported = 0 THEN 'no_supported_files' WHEN failed > 0 AND processed + cached > 0 THEN 'partial_success' WHEN failed > 0 THEN 'full_failure' WHEN processed > 0 THEN 'complete_success' ELSE 'cached_reuse' END AS outcome FROM s)
    SELECT *, CASE WHEN failed > 0 AND processed > 0 THEN 'partial' WHEN processed > 0 THEN 'exported' WHEN failed > 0 THEN 'failed' WHEN supported = 0 THEN 'empty' ELSE 'up_to_date' END AS status,
    CASE WHEN processed > 0 AND cached > 0 THEN 'partial_refresh' WHEN processed > 0 THEN 'full_refresh' WHEN supported = 0 OR failed > 0 THEN 'no_refresh' ELSE 'cached_reuse' END AS refresh, supported > 0 AND failed = 0 AS safe, cached = 0 AS prune,
    CASE outcome WHEN 'full_failure' THEN 'failed' WHEN 'cached_reuse' THEN 'unchanged' WHEN 'no_supported_files' THEN 'unchanged' WHEN 'partial_success' THEN 'incremental' ELSE CASE WHEN cached > 0 THEN 'incremental' ELSE 'fresh' END END AS update_class FROM o""",
)
def export_status(s, d):
    u = F.col("user_id")
    kind = lambda k, m: F.count_if((F.col("event_type") == k) & (u % m != 0))
    runs = t.table(s, d, "events").groupBy("user_id").agg(kind("purchase", 4).alias("processed"), kind("view", 3).alias("cached"), kind("error", 5).alias("failed"))
    return incremental.export_report(runs.withColumn("supported", F.col("processed") + F.col("cached") + F.col("failed")))


@query(
    "latest_index",
    f"WITH {t.VERSIONS} SELECT path, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(signature_hash, (ts, event_id)) AS signature_hash FROM versions GROUP BY path HAVING arg_max(event_id, (ts, event_id)) % 13 <> 0",
)
def latest_index(s, d):
    v = t.versions(s, d).withColumn("deleted", F.col("event_id") % 13 == 0)
    return index.latest_per_path(v).select("path", F.col("version.event_id").alias("event_id"), "signature_hash")


@query("config_overlay", "SELECT coalesce(g.n_nationkey, p.n_nationkey) AS language, CASE WHEN p.n_nationkey IS NOT NULL AND p.n_nationkey % 2 = 0 THEN 'o' || p.n_nationkey ELSE 'b' || g.n_nationkey END AS server_binary, CASE WHEN p.n_nationkey IS NOT NULL THEN p.n_nationkey % 6 <> 0 ELSE true END AS enabled FROM (SELECT * FROM nation WHERE n_nationkey < 20) g FULL JOIN (SELECT * FROM nation WHERE n_nationkey >= 10) p ON g.n_nationkey = p.n_nationkey")
def config_overlay(s, d):
    n, k = t.table(s, d, "nation"), F.col("n_nationkey")
    base = n.where("n_nationkey < 20").select(k.alias("language"), F.concat(F.lit("b"), k.cast("string")).alias("binary"), F.lit(True).alias("enabled"))
    over = n.where("n_nationkey >= 10").select(k.alias("language"), F.when(k % 2 == 0, F.concat(F.lit("o"), k.cast("string"))).alias("binary"), (k % 6 != 0).alias("enabled"))
    return config.overlay(base, over, "language").withColumnRenamed("binary", "server_binary")


@query("servers", "SELECT n_nationkey AS language, CASE WHEN n_nationkey % 5 = 0 THEN NULL WHEN n_nationkey % 2 = 0 THEN 'o' || n_nationkey ELSE 'b' || n_nationkey END AS server_binary FROM nation")
def servers(s, d):
    n, k = t.table(s, d, "nation"), F.col("n_nationkey")
    base = n.select(k.alias("language"), F.concat(F.lit("b"), k.cast("string")).alias("binary"), F.lit(True).alias("enabled"))
    over = n.select(k.alias("language"), F.when(k % 2 == 0, F.concat(F.lit("o"), k.cast("string"))).alias("binary"), F.when(k % 5 == 0, False).alias("enabled"))
    return config.servers(base, over).select("language", F.col("binary").alias("server_binary"))


@query("plugin_for", f"{_P} SELECT part_id, CASE {_EXT} WHEN 'toml' THEN 'toml' WHEN 'yml' THEN 'first' WHEN 'md' THEN 'first' WHEN 'txt' THEN 'second' END AS plugin FROM paths")
def plugin_for(s, d):
    plugins = s.createDataFrame([("toml", 0, ["toml"]), ("first", 1, ["yml", "md"]), ("second", 2, ["md", "txt", "toml"])], "plugin string, place int, extensions array<string>")
    return config.plugin_for(t.paths(s, d).withColumn("ext", text.extension(F.col("path"))), plugins).select("part_id", "plugin")


_SERVERS = "sv(language) AS (VALUES " + ", ".join(f"('{x}')" for x in fixed.EXTENSIONS) + ")"


def _servers(s):
    return s.createDataFrame([(x, "srv-" + x[0]) for x in fixed.EXTENSIONS], "language string, binary string")


@query("language_status", f"WITH {_SERVERS} SELECT language, language IN ({_IN(fixed.PATTERN_LANGUAGES)}) AS has_patterns, 'srv-' || left(language, 1) AS server_binary, left(language, 1) < 'm' AS available FROM sv")
def language_status(s, d):
    installed = s.createDataFrame([("srv-" + c,) for c in "abcdefghijkl"], "binary string")
    return config.language_status(s, _servers(s), installed).withColumnRenamed("binary", "server_binary")


@query("languages_by_binary", f"WITH {_SERVERS} SELECT 'srv-' || left(language, 1) AS server_binary, string_agg(language, ',' ORDER BY language) AS languages FROM sv GROUP BY left(language, 1)")
def languages_by_binary(s, d):
    return config.languages_by_binary(_servers(s)).withColumnRenamed("binary", "server_binary")


@query(
    "cache_scope",
    f"""WITH RECURSIVE b AS (SELECT n_nationkey AS k, '/w/' || n_name || CASE WHEN n_nationkey % 2 = 0 THEN '/w/.gitrefs/heads/main' ELSE '' END AS t FROM nation),
    f AS (SELECT k, hex(encode(t)) AS x, 1 AS i, {fixed.FNV_OFFSET}::HUGEINT AS h FROM b UNION ALL
      SELECT k, x, i + 2, ((h - h % 256 + xor((h % 256)::BIGINT, ('0x' || substring(x, i, 2))::BIGINT)) * {fixed.FNV_PRIME}::HUGEINT) % 18446744073709551616::HUGEINT FROM f WHERE i < length(x))
    SELECT k, lower(lpad(hex(h::UBIGINT), 16, '0')) AS scope FROM f WHERE i > length(x)""",
)
def cache_scope(s, d):
    git = F.col("n_nationkey") % 2 == 0
    scope = text.cache_scope(F.concat(F.lit("/w/"), "n_name"), F.when(git, "/w/.git"), F.when(git, "refs/heads/main"))
    return t.table(s, d, "nation").select(F.col("n_nationkey").alias("k"), scope.alias("scope"))
