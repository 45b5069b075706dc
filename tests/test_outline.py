"""Outlines against a plain restatement of the rules, on generated texts."""

import math
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from structlens.functions import fixed
from structlens.operators import outline
from structlens.sources.files import explode_lines

LINE = st.sampled_from(["fn a() {", "}", "  x = 1;", "\tdef b():", "    class C:", "// note", "", "# Title", "})", "if (x[", "]) {", "end", "        deep: value here", "aaaa", "{{{{", "label:", "* item"])


def depth_of(line: str) -> int:
    lead = re.match(r"\s*", line)[0]
    return math.ceil(sum(4 if c == "\t" else 1 for c in lead) / 4)


def expected(text: str) -> list[tuple]:
    lines = text.split("\n")
    if lines[-1] == "":
        lines.pop()
    lines = [x.removesuffix("\r") for x in lines]
    found, depth = [], 0
    for i, line in enumerate(lines):
        t = line.strip()
        heading = t.startswith(("# ", "## ", "### "))
        comment = t.startswith(("//", "/*", "*", "--", ";")) or (t.startswith("#") and not heading)
        if t and not comment:
            closers = len(re.match(r"[})\]]*", t)[0])
            own, effective = depth_of(line), depth_of(line) + max(0, depth - closers)
            named = bool(re.search(r"[^\W\d]", t))
            solid = re.sub(r"\s", "", t)
            varied = 20 * len(set(solid)) >= 9 * len(solid)
            if t.lower().startswith(tuple(fixed.DECLARATIONS)) or heading or (t[-1] in "{:" and named) or ((own == 0 or effective <= 1) and named and len(t.encode()) >= 4 and varied):
                found.append([i, effective, t])
        depth = max(0, depth + sum(c in "{[(" for c in t) - sum(c in "}])" for c in t))
    if not found:
        first = next((i for i, x in enumerate(lines) if x.strip()), None)
        if first is None:
            return []
        found.append([first, 0, lines[first].strip()])
    out = []
    for k, (i, d, t) in enumerate(found):
        stop = next((j for j, e, _ in found[k + 1 :] if e <= d), None)
        out.append((i + 1, (max(i, stop - 1) if stop is not None else len(lines) - 1) + 1, d, t))
    return out


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(LINE, max_size=25), min_size=20, max_size=40))
def test_outline(spark, texts):
    files = [(f"f{i}", "\n".join(x)) for i, x in enumerate(texts)]
    got = outline.outline(explode_lines(spark.createDataFrame(files, "file_path string, source string")))
    rows = {}
    for r in got.collect():
        rows.setdefault(r.file_path, []).append((r.line, r.line_end, r.depth, r.label))
    assert {f: sorted(v) for f, v in rows.items()} == {f: expected(s) for f, s in files if expected(s)}


def test_deep_regions_use_the_join(spark):
    text = "\n".join(" " * 4 * d + f"class L{d}:" for d in [*range(20), 15, 19, 14, 0])
    got = outline.outline(explode_lines(spark.createDataFrame([("f", text)], "file_path string, source string"))).collect()
    assert sorted((r.line, r.line_end, r.depth, r.label) for r in got) == expected(text)


def test_fnv(spark):
    def fnv(b):
        h = fixed.FNV_OFFSET
        for x in b:
            h = (h ^ x) * fixed.FNV_PRIME % (1 << 64)
        return h

    for text in ("fn main() {", "é ü", "x"):
        row = outline.outline(explode_lines(spark.createDataFrame([("f", text)], "file_path string, source string"))).first()
        assert row.region_id == f"h-{fnv(text.encode()):016x}-1"
