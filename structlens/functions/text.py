"""Scalar functions of lines, names and paths as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def trim(c: Column) -> Column:
    """Without ASCII white space at both ends."""
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def count_of(c: Column, needle: str) -> Column:
    """Occurrences of a text that don't overlap."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(needle), F.lit("")))) / F.lit(len(needle))).cast("long")


def chars_of(c: Column, chars: str) -> Column:
    """How many characters of ``c`` are in ``chars``."""
    return F.length(c) - F.length(F.translate(c, chars, ""))


def indent_depth(line: Column) -> Column:
    """Leading white space in steps of four, rounded up; a tab is four."""
    lead = F.regexp_extract(line, r"^(\s*)", 1)
    return F.ceil((F.length(lead) + chars_of(lead, "\t") * 3) / F.lit(4)).cast("int")


def is_heading(t: Column) -> Column:
    return t.startswith("# ") | t.startswith("## ") | t.startswith("### ")


def is_comment(t: Column) -> Column:
    marks = ["//", "/*", "*", "--", ";"]
    out = t.startswith("#") & ~is_heading(t)
    for m in marks:
        out = out | t.startswith(m)
    return out


def has_identifier(t: Column) -> Column:
    return t.rlike(r"[\p{IsAlphabetic}_]")


def varied(t: Column) -> Column:
    """At least 45 % of the characters other than white space are distinct (in integers)."""
    s = F.regexp_replace(t, r"\s+", "")
    distinct = F.size(F.array_distinct(F.split(s, "")))
    return (s != "") & (distinct * 20 >= F.length(s) * 9)


def is_structural(t: Column, indent: Column, depth: Column) -> Column:
    low = F.lower(t)
    declared = low.rlike("^(" + "|".join(fixed.DECLARATIONS) + ")")
    block = (t.endswith("{") | t.endswith(":")) & has_identifier(t)
    prose = ((indent == 0) | (depth <= 1)) & has_identifier(t) & (F.octet_length(t) >= 4) & varied(t)
    return declared | is_heading(t) | block | prose


def compact_label(t: Column) -> Column:
    return F.when(F.length(t) > 80, F.concat(F.left(t, F.lit(80)), F.lit("..."))).otherwise(t)


def fnv1a(c: Column) -> Column:
    """64-bit FNV-1a of the UTF-8 bytes, as DECIMAL(20,0)."""
    wide = lambda x: x.cast("decimal(20,0)")
    codes = F.transform(F.filter(F.split(F.hex(F.encode(c, "UTF-8")), "(?<=\\G..)"), lambda h: h != ""), lambda h: F.conv(h, 16, 10).cast("int"))

    def step(h: Column, byte: Column) -> Column:
        low = F.pmod(h, F.lit(256).cast("decimal(20,0)")).cast("int")
        return wide(((h - wide(low) + wide(low.bitwiseXOR(byte))).cast("decimal(20,0)") * F.lit(fixed.FNV_PRIME).cast("decimal(13,0)")) % F.lit(str(1 << 64)).cast("decimal(20,0)"))

    return F.aggregate(codes, F.lit(str(fixed.FNV_OFFSET)).cast("decimal(20,0)"), step)


def hex16(h: Column) -> Column:
    """A DECIMAL(20,0) of 64 bits as 16 lower-case hex digits."""
    return F.lpad(F.lower(F.conv(h.cast("string"), 10, 16)), 16, "0")


def qualified_name(scope: Column, name: Column) -> Column:
    return F.array_join(F.concat(scope, F.array(name)), "::")


def stable_id(path: Column, qualified: Column, line: Column, col: Column) -> Column:
    return F.concat(path, F.lit("::"), qualified, F.lit("@"), line.cast("string"), F.lit(":"), col.cast("string"))


def extension(path: Column) -> Column:
    """The text after the last dot of the file name, "" if there is none or the name only starts with it."""
    return F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def sanitize_path(path: Column, root: Column) -> Column:
    """Relative to the root if inside it, the file name if absolute and outside, unchanged if relative."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    inside = F.startswith(p, F.concat(root, F.lit("/")))
    return F.when(inside, F.substring(p, F.length(root) + 2, F.length(p))).when(p.startswith("/"), file_name(p)).otherwise(p)


def description(signature: Column, doc: Column) -> Column:
    return F.concat_ws("\n\n", signature, doc)


def skeleton(text: Column) -> Column:
    """The first line that isn't blank, as it is; "" if there is none."""
    return F.coalesce(F.get(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"\S")), F.lit(0)), F.lit(""))


def labels(kind: Column, signature: Column) -> Column:
    base = F.array().cast("array<string>")
    for k, names in fixed.LABELS.items():
        base = F.when(kind == k, F.array(*[F.lit(n) for n in names])).otherwise(base)
    public = F.when(signature.startswith("pub ") | signature.startswith("pub("), F.lit("public"))
    return F.concat(base, F.array_compact(F.array(public, F.when(signature.contains("async"), F.lit("async")))))


def is_exported(ext: Column, name: Column, signature: Column) -> Column:
    """By the language's own rule for what a file offers to others."""
    return (
        F.when(ext == "rs", signature.startswith("pub ") | signature.startswith("pub("))
        .when(ext == "py", ~name.startswith("_"))
        .when(ext.isin("js", "jsx", "ts", "tsx", "mjs"), signature.contains("export"))
        .when(ext == "go", name.rlike(r"^\p{Lu}"))
        .otherwise(F.lit(True))
    )


def surface(path: Column) -> Column:
    """Build, Documentation, Configuration or null, in this precedence."""
    low = F.lower(path)
    name, ext = file_name(low), extension(low)
    docs = low.contains("/docs/") | low.contains("/doc/") | name.isin(fixed.DOC_FILES) | ext.isin(fixed.DOC_EXTENSIONS)
    config = name.isin(fixed.MANIFESTS) | ext.isin(fixed.CONFIG_EXTENSIONS) | low.contains("/config/") | low.contains("/configs/") | low.contains("/manifest")
    return F.when(name.isin(fixed.BUILD_FILES), "Build").when(docs, "Documentation").when(config, "Configuration")


def is_test_path(path: Column) -> Column:
    """The strict rule, for impact: "/test" or "_test" in the path, or a component "tests"."""
    return path.contains("/test") | path.contains("_test") | path.rlike(r"(^|/)tests(/|$)")


def mentions_test(path: Column) -> Column:
    """The lax rule, for summaries."""
    return F.lower(path).rlike("test|spec")


def is_test_function(name: Column, doc: Column) -> Column:
    named = name.startswith("test_") | name.startswith("it_") | name.startswith("should_") | name.endswith("_test")
    return named | F.coalesce(doc.contains("#[test]") | doc.contains("@Test"), F.lit(False))


def module_of(path: Column) -> Column:
    """First component of a relative path, null if it is a file name."""
    first = F.get(F.split(path, "/"), F.lit(0))
    return F.when(~first.contains("."), first)


def entry_kind(has_main: Column, path: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, kind in fixed.ENTRY_FILES.items():
        out = F.when(file_name(path) == name, kind).otherwise(out)
    return F.when(has_main, "main()").otherwise(out)


def complexity_of(line: Column) -> Column:
    """What one line adds to the complexity of a function; comment lines add nothing."""
    t = trim(line)
    total = F.lit(0).cast("long")
    for kw in fixed.BRANCHES:
        total = total + count_of(t, kw)
    return F.when(t.startswith("//") | t.startswith("#") | t.startswith("/*"), F.lit(0).cast("long")).otherwise(total)


def complexity_rating(n: Column) -> Column:
    return F.when(n <= 5, "simple").when(n <= 10, "moderate").when(n <= 20, "complex").otherwise("very complex")


def utf16_offset(line: Column, column: Column) -> Column:
    """Byte offset of a UTF-16 column; null if it falls into a surrogate pair or behind the line."""
    chars = F.filter(F.split(line, ""), lambda c: c != "")
    start = F.struct(F.lit(0).alias("units"), F.lit(0).alias("bytes"), F.when(column == 0, 0).alias("hit"))

    def step(a: Column, c: Column) -> Column:
        size = F.octet_length(c)
        units, size_ = a["units"] + F.when(size == 4, 2).otherwise(1), a["bytes"] + size
        return F.struct(units.alias("units"), size_.alias("bytes"), F.coalesce(a["hit"], F.when(units == column, size_)).alias("hit"))

    return F.aggregate(chars, start, step, lambda a: a["hit"])


def identifier_at(line: Column, column: Column) -> Column:
    """The identifier around a byte column; null outside of one or of the line, or if the column is within a character."""
    whole = F.encode(line, "UTF-8")
    at = F.hex(F.substring(whole, column + 1, F.lit(1)))
    # a byte that goes on with a character begins with the bits 10
    before = F.when((at != "") & ~at.between("80", "BF"), F.decode(F.substring(whole, F.lit(1), column), "UTF-8"))
    after = F.substring(line, F.length(before) + 1, F.length(line))
    ok = (column < F.octet_length(line)) & after.rlike(r"^[\p{IsAlphabetic}\p{N}_]")
    return F.when(ok, F.concat(F.regexp_extract(before, r"([\p{IsAlphabetic}\p{N}_]*)$", 1), F.regexp_extract(after, r"^([\p{IsAlphabetic}\p{N}_]+)", 1)))


def valid_git_ref(ref: Column) -> Column:
    return ref.rlike(r"^[A-Za-z0-9/_.~^@{} -]+$")


def worktree_id(git_dir: Column) -> Column:
    """"main" for a plain checkout, the name of a linked worktree, else the path."""
    linked = F.regexp_extract(git_dir, r"/worktrees/([^/]+)/?$", 1)
    return F.when(linked != "", linked).when(git_dir.rlike(r"(^|/)\.git/?$"), "main").otherwise(git_dir)


def severity(code: Column) -> Column:
    return F.when(code == 1, "Error").when(code == 3, "Information").when(code == 4, "Hint").otherwise("Warning")


def parameters(signature: Column) -> Column:
    """name and type of each parameter in the first balanced parentheses, without the receiver.

    Commas inside brackets of any kind don't separate; the text before the first colon is the name."""
    inner = F.regexp_extract(signature, r"\(((?:[^()]|\((?:[^()]|\([^()]*\))*\))*)\)", 1)
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("now"), F.array().cast("array<string>").alias("done"))

    def step(a: Column, c: Column) -> Column:
        depth = a["depth"] + F.when(c.isin("(", "<"), 1).when(c.isin(")", ">"), -1).otherwise(0)
        cut = (c == ",") & (a["depth"] == 0)
        return F.struct(depth.alias("depth"), F.when(cut, "").otherwise(F.concat(a["now"], c)).alias("now"), F.when(cut, F.concat(a["done"], F.array(a["now"]))).otherwise(a["done"]).alias("done"))

    parts = F.aggregate(F.split(inner, ""), start, step, lambda a: F.concat(a["done"], F.array(a["now"])))
    named = F.filter(F.transform(parts, trim), lambda p: (p != "") & ~p.isin("self", "&self", "&mut self"))
    return F.transform(named, lambda p: F.struct(trim(F.substring_index(p, ":", 1)).alias("name"), F.when(p.contains(":"), trim(F.substring(p, F.instr(p, ":") + 1, F.length(p)))).alias("type")))


def symbol_kind(code: Column) -> Column:
    """The kind of a symbol by the number that language servers use."""
    out = F.lit("Variable")
    for number, kind in fixed.SERVER_KINDS.items():
        out = F.when(code == number, kind).otherwise(out)
    return out


def display_name(language: Column) -> Column:
    """The name of a language for people; of an unknown one the name itself."""
    out = language
    for name, shown in fixed.DISPLAY_NAMES.items():
        out = F.when(language == name, shown).otherwise(out)
    return out


def line_count(source: Column) -> Column:
    """Lines of a text; nothing after a final line feed is none."""
    n = F.length(source) - F.length(F.replace(source, F.lit("\n"), F.lit("")))
    return n + F.when((source != "") & ~source.endswith("\n"), 1).otherwise(0)


def normal_path(path: Column) -> Column:
    """A path without "." and ".." components; ".." above the root stays out."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: ~p.isin("", "."))
    step = lambda a, p: F.when(p == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p)))
    joined = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    return F.when(path.startswith("/"), F.concat(F.lit("/"), joined)).otherwise(joined)


def is_within(path: Column, root: Column) -> Column:
    """The path, relative to the root if it isn't absolute, is the root or below it, component by component."""
    base = F.regexp_replace(normal_path(root), "/$", "")
    whole = normal_path(F.when(path.startswith("/"), path).otherwise(F.concat(root, F.lit("/"), path)))
    return (whole == base) | F.startswith(whole, F.concat(base, F.lit("/")))


def choose_backend(tool: Column, has_patterns: Column, has_server: Column, has_plugin: Column) -> Column:
    """patterns, server, plugin, heuristic or unavailable: what serves a tool for a language."""
    outline = F.when(has_server, "server").when(has_plugin, "plugin").otherwise("heuristic")
    own = F.when(tool.isin(fixed.OUTLINE_SERVES) & ~has_patterns, outline).otherwise("patterns")
    return F.when(tool.isin(fixed.NEEDS_SERVER), F.when(has_server, "server").otherwise("unavailable")).when(tool.isin(fixed.PREFERS_SERVER) & has_server, "server").otherwise(own)


def cache_scope(root: Column, git_dir: Column, head: Column) -> Column:
    """The name of a project's cache: a hash of its root and, in a checkout, of the git folder and the head."""
    nothing = F.lit("")
    return hex16(fnv1a(F.concat(root, F.coalesce(git_dir, nothing), F.coalesce(head, nothing))))
