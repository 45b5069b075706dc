"""Statements of source files, found by brackets and terminators in code without comments and strings.

In languages with braces a statement runs over any number of lines up to its semicolon, its line end where the language ends statements so, or its
block; several may be on a line, and those within a block have the block's statement as owner. In the others each line of code is taken
as the head of a block by indentation (Python) or up to the next ``end`` of the same indentation (Ruby, Lua, Elixir).
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

from . import lexing
from .ordered import first_at_most

INDENTED = ("python", "haskell", "yaml")
ENDED = ("ruby", "lua", "elixir", "julia")
#: Languages with braces in which only semicolons end statements.
SEMICOLONS = ("rust", "java", "c", "cpp", "csharp", "php", "zig")
_C = ("c", "cpp")

_MARKS, _COMMAS = re.compile(r"[{}()\[\];\n]"), re.compile(r"[{}()\[\];\n,]")
_MIDDLE = re.compile(r"(?:else|elsif|elseif|rescue|ensure|catch|after|when)\b")
_END = re.compile(r"end\b")
_ROUND = r"\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)"
_MARK = r"@(?!interface\b)[\w.]+(?:\s*" + _ROUND + ")?"
#: What may stand before a declaration and isn't part of it.
_BEFORE = {
    "rust": r"#!?\[(?:[^\[\]]|\[[^\[\]]*\])*\]", "java": _MARK, "typescript": _MARK, "javascript": _MARK, "swift": _MARK, "kotlin": _MARK, "dart": _MARK,
    "csharp": r"\[(?:[^\[\]]|\[[^\[\]]*\])*\]", "php": r"#\[[^\]]*\]",
    "cpp": r"(?:public|private|protected)\s*:(?!:)|\[\[[^\]]*\]\]|template\s*<(?:[^<>]|<(?:[^<>]|<[^<>]*>)*>)*>",
}
_BEFORE = {language: re.compile(rf"\s*(?:(?:{pattern})\s*)*") for language, pattern in _BEFORE.items()}
_PLAIN = re.compile(r"\s*")
_MACRO = re.compile(r"\w!(?: ?\w+)?$")
_AGGREGATE = re.compile(r"\b(?:struct|union|enum|class)\b[^()]*$")
_DECLARES = re.compile(r"\b(?:class|interface|struct|enum|protocol|func|function|fun|object|trait|extension|namespace)\b")
_GOES_ON = re.compile(r"\s*(?:\.(?!\.)|:(?!:)|\?\.|&&|\|\||->|=>|(?:extends|implements|where|throws)\b)")
_LISTS = re.compile(r"\s*(?:import|export)(?:\s+type)?\s*\Z|\s*(?:import|export)\s+\w+\s*,\Z")
_GROUP = re.compile(r"\s*type\s*\Z")
_TYPEDEF = re.compile(r"\s*typedef\s*")
Spans = list[tuple[int, int, str]]
_DIRECTIVE = re.compile(r"^[ \t]*#(?:[^\n\\]|\\[\s\S])*", re.MULTILINE)


@dataclass(slots=True)
class Statement:
    """Places in the file; ``flat`` is where it ends if what it declares has no block, ``owner`` the number of the statement whose block holds it (-1: none)."""

    start: int
    end: int
    flat: int
    head: str
    owner: int
    depth: int


def _stop(code: str, begin: int, at: int) -> int:
    """Behind the last character before ``at`` that isn't blank, but not before ``begin``."""
    while at > begin and code[at - 1].isspace():
        at -= 1
    return at


def _solid(code: str, spans: Spans, begin: int, at: int) -> tuple[int, bool]:
    """Behind the last character before ``at`` of code or of a string (but not before ``begin``), and whether that is a string's."""
    stop, k = _stop(code, begin, at), bisect_right(spans, (at, -1, "")) - 1
    while k >= 0 and spans[k][1] > stop:
        start, end, what = spans[k]
        if what == lexing.STRING and start >= begin and end <= at:
            return end, True
        k -= 1
    return stop, False


def _goes_on(code: str, begin: int, at: int, language: str | None) -> bool:
    """Whether a statement, whose last character is before ``at``, goes on behind the line end there."""
    if code[at - 1] in ",=<>&|?:.*/+-" and code[at - 2 : at] not in ("++", "--"):
        return True
    if _GOES_ON.match(code, at):
        return True
    opens = _PLAIN.match(code, at).end()
    return code[opens : opens + 1] == "{" and bool(_DECLARES.search(code, begin, at) or language == "bash" and code[at - 1] == ")")


def in_braces(code: str, language: str | None, spans: Spans = ()) -> list[Statement]:
    """All statements of a file whose blocks are in braces."""
    out: list[Statement] = []
    before = _BEFORE.get(language, _PLAIN)
    lines_end, of_c, macros = language not in SEMICOLONS, language in _C, language == "rust"
    frames: list[tuple] = []
    grouped: list[int] = []
    begin, brackets, owner, depth, after, hidden = 0, 0, -1, 0, -1, 0

    def add(at: int, end: int, opens: bool) -> int:
        start = before.match(code, begin, at).end()
        if start < at and not hidden:
            head = " ".join(code[start:at].split())
            out.append(Statement(start, end, end, head + (" {" if opens else " ;"), owner, depth))
            return len(out) - 1
        return -1

    if of_c or language == "csharp":  # directives are lines, and their brackets don't count
        for m in _DIRECTIVE.finditer(code):
            out.append(Statement(m.start() + len(m[0]) - len(m[0].lstrip()), m.end(), m.end(), " ".join(m[0].replace("\\\n", " ").split()), -1, 0))
        code = _DIRECTIVE.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), code)

    for m in (_COMMAS if language == "zig" else _MARKS).finditer(code):
        mark, at = m[0], m.start()
        if mark == "\n":
            if lines_end and not brackets and after < 0:
                stop, string = _solid(code, spans, begin, at)
                if stop > begin and (string or not _goes_on(code, begin, stop, language)):
                    add(stop, stop, False)
                    begin = at + 1
        elif mark == ",":
            if not brackets and owner >= 0 and out[owner].head.endswith(("struct {", "union {", "enum {")):
                begin = at + 1  # behind a field
        elif mark == "(" and language == "go" and not brackets and _GROUP.match(code, begin, at):
            number = add(at, at, True)  # declarations in one pair of brackets, a line each
            grouped.append(number)
            frames.append((begin, brackets, owner, depth, after, hidden, number))
            begin, owner, depth = at + 1, number, depth + 1
        elif mark in "([":
            brackets += 1
        elif mark in ")]":
            if grouped and not brackets and mark == ")" and frames and frames[-1][6] == grouped[-1]:
                grouped.pop()
                if (stop := _solid(code, spans, begin, at)[0]) > begin:
                    add(stop, stop, False)
                _, brackets, owner, depth, after, hidden, number = frames.pop()
                out[number].end = out[number].flat = begin = at + 1
            elif not brackets and _stop(code, begin, at) == begin:
                begin = at + 1  # shuts nothing
            brackets = max(brackets - 1, 0)
        elif mark == ";":
            if not brackets:
                if after >= 0:  # behind the block of a type: names of a typedef, or variables
                    if out[after].head.startswith("typedef"):
                        tail = " ".join(code[begin:at].split())
                        out[after].head, out[after].end, out[after].flat = f"{out[after].head} }} {tail} ;", at + 1, at + 1
                else:
                    add(at, at + 1, False)
                begin, after = at + 1, -1
        elif mark == "{":
            stop = _stop(code, begin, at)
            if brackets or after >= 0 or code[stop - 1 : stop] == "=" and stop > begin or _LISTS.match(code, begin, stop):
                frames.append((begin, brackets, owner, depth, after, hidden, None))
            else:
                number = add(at, at, True)
                frames.append((begin, brackets, owner, depth, after, hidden, number))
                if number >= 0:
                    owner, depth = number, depth + 1
                hidden += macros and number >= 0 and bool(_MACRO.search(out[number].head[:-2]))
            begin, brackets, after = at + 1, 0, -1
        else:
            if not brackets and after < 0 and (stop := _solid(code, spans, begin, at)[0]) > begin:
                add(stop, stop, False)
            if not frames:
                begin, brackets, after = at + 1, 0, -1
                continue
            begin, brackets, owner, depth, after, hidden, number = frames.pop()
            if number is None:  # the statement goes on
                continue
            begin = at + 1
            if number >= 0:
                out[number].end = out[number].flat = at + 1
                if of_c and _AGGREGATE.search(out[number].head[:-2]):
                    after = number
                    if out[number].head.startswith("typedef "):  # the type itself, within the typedef
                        inner = _TYPEDEF.match(code, out[number].start).end()
                        out.append(Statement(inner, at + 1, at + 1, out[number].head.removeprefix("typedef "), out[number].owner, out[number].depth))
    if not brackets and after < 0 and (stop := _solid(code, spans, begin, len(code))[0]) > begin:
        add(stop, stop, False)
    for _, _, _, _, _, _, number in frames:  # blocks that nothing shuts reach to the end
        if number is not None and number >= 0:
            out[number].end = out[number].flat = len(code.rstrip())
    return out


def _line_ends(language: str | None, code: list[str], solid: list[bool], into: list[int]) -> list[int]:
    """The last line of each line, taken as the head of a block."""
    n = len(code)
    lead = [len(white) + 7 * white.count("\t") for white in (c[: len(c) - len(c.lstrip())] for c in code)]
    before, last = [], -1  # the last solid line up to each
    for i in range(n):
        last = i if solid[i] else last
        before.append(last)
    stripped = [c.strip() for c in code]
    ended = language in ENDED
    # a line within brackets goes on with the one before
    able = [solid[i] and not into[i] and not (ended and _MIDDLE.match(stripped[i])) for i in range(n)]
    out = list(range(n))
    for i, j in enumerate(first_at_most(lead, lead, candidate=able)):
        if not ended:
            out[i] = max(i, before[(j if j >= 0 else n) - 1])
        elif j < 0:
            out[i] = max(i, before[n - 1])
        elif _END.match(stripped[j]) and lead[j] == lead[i]:
            out[i] = j
    return out


def levels(lines: list[str]) -> tuple[list[int], list[int]]:
    """The bracket depth before and behind each line of code; it never goes below zero."""
    into, left, level = [], [], 0
    for line in lines:
        into.append(level)
        level = max(0, level + sum(map(line.count, "{[(")) - sum(map(line.count, "}])")))
        left.append(level)
    return into, left


def block_ends(code: str, language: str | None) -> list[int]:
    """The last line of each line of a file, taken as the head of a block."""
    lines = code.split("\n")
    solid = [bool(line.strip()) for line in lines]
    into, left = levels(lines)
    if language in INDENTED or language in ENDED:
        return _line_ends(language, lines, solid, into)
    n = len(lines)
    shut = [n - 1 if j < 0 else j for j in first_at_most(left, into, own=True)]
    out, following = [0] * n, n
    for i in range(n - 1, -1, -1):
        # a body that opens on the next line
        nearby = following < n and lines[following].lstrip().startswith("{") and left[i] == into[i]
        out[i] = shut[following] if nearby else shut[i]
        if solid[i]:
            following = i
    return out


def by_lines(code: str, language: str | None, spans: Spans = ()) -> list[Statement]:
    """Each line of code as a statement, with the block that it would be the head of."""
    lines = code.split("\n")
    solid = [bool(line.strip()) for line in lines]
    into, left = levels(lines)
    ends = _line_ends(language, lines, solid, into)
    shut = first_at_most(left, into, own=True)
    starts, at = [], 0
    for line in lines:
        starts.append(at)
        at += len(line) + 1
    out, around = [], []
    stop = lambda i: _solid(code, spans, starts[i], starts[i] + len(lines[i]))[0]
    for i, line in enumerate(lines):
        if not solid[i]:
            continue
        while around and around[-1][0] < i:
            around.pop()
        flat = shut[i] if shut[i] >= 0 else i
        out.append(Statement(starts[i] + len(line) - len(line.lstrip()), stop(ends[i]), max(stop(flat), stop(i)), line.rstrip() + " ", around[-1][1] if around else -1, len(around)))
        if ends[i] > i:
            around.append((ends[i], len(out) - 1))
    return out


class File:
    """A source with its code (comments and strings blank) and its lines."""

    def __init__(self, source: str, language: str | None):
        self.source, self.language = source, language
        self.spans = lexing.spans(source, language)
        self.code = lexing.blanked(source, self.spans)
        self.starts = [0, *(m.end() for m in re.finditer("\n", source))]
        self.plain = len(source) == len(source.encode("utf-8", "surrogatepass"))

    def statements(self) -> list[Statement]:
        return (by_lines if self.language in INDENTED or self.language in ENDED else in_braces)(self.code, self.language, self.spans)

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at) - 1

    def column(self, at: int, line: int) -> int:
        """In bytes."""
        start = self.starts[line]
        return at - start if self.plain else len(self.source[start:at].encode("utf-8", "surrogatepass"))

    def text_of(self, line: int) -> str:
        return self.source[self.starts[line] : self.starts[line + 1] - 1 if line + 1 < len(self.starts) else len(self.source)]

    def code_of(self, line: int) -> str:
        return self.code[self.starts[line] : self.starts[line + 1] - 1 if line + 1 < len(self.starts) else len(self.code)].strip()

    def inside(self, line: int) -> bool:
        """Whether a line begins within a longer comment or string."""
        at = self.starts[line]
        k = bisect_right(self.spans, (at, 0, "")) - 1
        return k >= 0 and self.spans[k][0] < at < self.spans[k][1]

    def comment_above(self, line: int) -> str | None:
        """The comment lines above a line; attributes and blank lines in between are skipped."""
        found = []
        for k in range(line - 1, -1, -1):
            code, text = self.code_of(k), self.text_of(k)
            t = text.strip()
            if not code:
                if t and (self.language != "python" or t.startswith("#")):
                    found.append(text.rstrip() if self.inside(k) else t)
                elif t:
                    break
            elif not code.startswith(("#[", "@")):
                break
        return "\n".join(reversed(found)) or None

    def docstring(self, head: int, end: int) -> str | None:
        """The string that a Python body begins with, with its quotes; ``head`` is where the header ends."""
        at = _PLAIN.match(self.source, head).end()
        k = bisect_right(self.spans, (at, len(self.source) + 1, "")) - 1
        prefix = re.compile(r"[rRbBuUfF]{0,2}").match(self.source, at).end()
        for start, stop, what in self.spans[max(k, 0) : k + 3]:
            if what == lexing.STRING and start in (at, prefix) and stop <= end + 1:
                return self.source[at:stop]
        return None
