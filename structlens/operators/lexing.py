"""Code, comments and strings of source texts.

The lexical rules of a language are one regular expression of what can open: comments and most strings are matched whole; nested comments, template
strings, heredocs and regular expression literals have a state that the scan carries on from line to line. One scan of a
file gives its spans; with them blanked out, places and lines stay where they are.
"""

from __future__ import annotations

import re
from functools import cache

COMMENT, STRING = "comment", "string"

_GAP = re.compile(r"[^\n]")
_WORD_BEFORE = re.compile(r"([\w$]+)$")
#: Words after which a slash opens a regular expression and doesn't divide.
_BEFORE_REGEX = {"return", "typeof", "instanceof", "in", "of", "new", "delete", "void", "throw", "case", "do", "else", "yield", "await", "and", "or", "not", "if", "unless", "when", "while"}
_REGEX_BODY = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
_TEMPLATE = re.compile(r"\\[\s\S]|`|\$\{")

# comments
_SLASHES, _BLOCK, _HASHES = r"//[^\n]*", r"/\*[\s\S]*?(?:\*/|\Z)", r"#[^\n]*"
# strings that end with their line, and strings that don't
_DOUBLE, _SINGLE = r'"(?:\\[\s\S]|[^"\\\n])*"?', r"'(?:\\[\s\S]|[^'\\\n])*'?"
_LONG_DOUBLE, _LONG_SINGLE = r'"(?:\\[\s\S]|[^"\\])*(?:"|\Z)', r"'(?:\\[\s\S]|[^'\\])*(?:'|\Z)"
_THREE, _THREE_SINGLE = r'"""(?:\\[\s\S]|[^\\])*?(?:"""|\Z)', r"'''(?:\\[\s\S]|[^\\])*?(?:'''|\Z)"
_LETTER = r"(?<![\w'])'(?:\\(?:u\{[^}\n]*\}|[^\n][^'\n]*)|[^'\\\n])'"
_INNER = r'(?:[^{}"\n]|"(?:\\.|[^"\\\n])*"|\{[^{}\n]*\})*'
_HEREDOC = r"(?P<hq>[\"'`\\]?)(?P<hd>[A-Za-z_]\w*)(?P=hq)"


def _interpolated(opens: str, long: bool = False) -> str:
    """A string in double quotes whose expressions, between braces after ``opens``, may hold strings."""
    return rf'"(?:{opens}\{{{_INNER}\}}|\\[\s\S]|[^"\\{"" if long else chr(92) + "n"}])*' + (r'(?:"|\Z)' if long else '"?')


#: language -> what can open, in order: (c)omment, (s)tring or a name of its own. Keys without rules go by "c".
_OPENERS: dict[str, list[tuple[str, str]]] = {
    "rust": [("c", _SLASHES), ("nested", r"/\*"), ("s", r"\b[bc]?r(?P<h>#*)\"[\s\S]*?(?:\"(?P=h)|\Z)"), ("s", _LONG_DOUBLE), ("s", r"\bb" + _LETTER[len(r"(?<![\w'])") :]), ("s", _LETTER)],
    "python": [("c", _HASHES), ("s", _THREE), ("s", _THREE_SINGLE), ("s", _DOUBLE), ("s", _SINGLE)],
    "javascript": [("c", _SLASHES), ("c", _BLOCK), ("s", _DOUBLE), ("s", _SINGLE), ("template", "`"), ("brace", "[{}]"), ("regex", "/")],
    "go": [("c", _SLASHES), ("c", _BLOCK), ("s", _DOUBLE), ("s", r"`[^`]*(?:`|\Z)"), ("s", _LETTER)],
    "java": [("c", _SLASHES), ("c", _BLOCK), ("s", _THREE), ("s", _DOUBLE), ("s", _SINGLE)],
    "c": [("c", _SLASHES), ("c", _BLOCK), ("s", _DOUBLE), ("s", r"(?<!\d)" + _SINGLE)],
    "cpp": [("c", _SLASHES), ("c", _BLOCK), ("s", r"R\"(?P<h>[^()\\\s]{0,16})\([\s\S]*?(?:\)(?P=h)\"|\Z)"), ("s", _DOUBLE), ("s", r"(?<![\da-fA-F])" + _SINGLE)],
    "csharp": [("c", _SLASHES), ("c", _BLOCK), ("s", r"(?P<h>\"{3,})[\s\S]*?(?:(?P=h)|\Z)"), ("s", r"(?:@\$?|\$@)\"(?:\"\"|[^\"])*(?:\"|\Z)"), ("s", r"\$" + _interpolated("")), ("s", _DOUBLE), ("s", _LETTER)],
    "swift": [("c", _SLASHES), ("nested", r"/\*"), ("s", r"(?P<h>#*)\"\"\"[\s\S]*?(?:\"\"\"(?P=h)|\Z)"), ("s", r"(?P<k>#+)\"[^\n]*?\"(?P=k)"), ("s", r'"(?:\\\((?:[^()"\n]|"[^"\n]*"|\([^()\n]*\))*\)|\\[\s\S]|[^"\\\n])*"?')],
    "kotlin": [("c", _SLASHES), ("nested", r"/\*"), ("s", r'"""[\s\S]*?(?:"""|\Z)'), ("s", _interpolated(r"\$")), ("s", _LETTER)],
    "php": [("s", r"\?>[\s\S]*?(?:<\?php\b|<\?=|\Z)"), ("s", r"<\?(?:php\b|=)"), ("c", _SLASHES), ("c", r"#(?!\[)[^\n]*"), ("c", _BLOCK), ("heredoc", r"<<<[ \t]*" + _HEREDOC), ("s", _LONG_DOUBLE), ("s", _LONG_SINGLE)],
    "ruby": [
        ("c", r"^=begin\b[\s\S]*?(?:^=end[^\n]*|\Z)"), ("c", _HASHES), ("heredoc", r"(?<![\w)\]])<<[~-]?" + _HEREDOC.replace("[A-Za-z_]", "[A-Z_]")), ("s", _interpolated("#", long=True)), ("s", _LONG_SINGLE),
        ("s", r"(?<![\w)\]])%[qQwWiIrx]?(?:\((?:\\.|[^()\\])*\)|\[(?:\\.|[^\]\\])*\]|\{(?:\\.|[^{}\\])*\})"), ("regex", "/"),
    ],
    "bash": [("c", r"(?<![^\s;&|()])#[^\n]*"), ("heredoc", r"(?<!<)<<-?[ \t]*" + _HEREDOC), ("s", r"\$\{[^}\n]*\}"), ("s", r"\\[\s\S]"), ("s", r'"(?:\$\((?:[^()"]|"[^"]*"|\([^()]*\))*\)|\\[\s\S]|[^"\\])*(?:"|\Z)'), ("s", r"'[^']*(?:'|\Z)")],
    "elixir": [("c", _HASHES), ("s", r"\?\\?[\"'#]"), ("s", _THREE), ("s", _THREE_SINGLE), ("s", r"~[a-zA-Z]+(?:\((?:\\.|[^)\\])*\)|\[(?:\\.|[^\]\\])*\]|\{(?:\\.|[^}\\])*\}|/(?:\\.|[^/\\\n])*/|\|(?:\\.|[^|\\\n])*\|)"), ("s", _interpolated("#", long=True)), ("s", _LONG_SINGLE)],
    "lua": [("c", r"--\[(?P<h>=*)\[[\s\S]*?(?:\](?P=h)\]|\Z)"), ("c", r"--[^\n]*"), ("s", r"\[(?P<k>=*)\[[\s\S]*?(?:\](?P=k)\]|\Z)"), ("s", _DOUBLE), ("s", _SINGLE)],
    "haskell": [("nested", r"\{-"), ("c", r"--+(?![!#$%&*+./<=>?@\\^|~:])[^\n]*"), ("s", _DOUBLE), ("s", _LETTER)],
    "zig": [("c", _SLASHES), ("s", r"\\\\[^\n]*"), ("s", _DOUBLE), ("s", _SINGLE)],
    "dart": [("c", _SLASHES), ("nested", r"/\*"), ("s", _THREE), ("s", _THREE_SINGLE), ("s", _interpolated(r"\$")), ("s", _SINGLE)],
    "ocaml": [("nested", r"\(\*"), ("s", _LONG_DOUBLE), ("s", _LETTER)],
    "fsharp": [("c", _SLASHES), ("nested", r"\(\*"), ("s", _THREE), ("s", _LONG_DOUBLE), ("s", _LETTER)],
    "clojure": [("c", r";[^\n]*"), ("s", r"\\[\"; ]"), ("s", _LONG_DOUBLE)],
    "julia": [("nested", r"#="), ("c", _HASHES), ("s", _THREE), ("s", _DOUBLE)],
    "yaml": [("c", r"(?<![^\s])#[^\n]*"), ("s", _DOUBLE), ("s", r"(?<![\w])'(?:''|[^'\n])*'?")],
    "terraform": [("c", _HASHES), ("c", _SLASHES), ("c", _BLOCK), ("heredoc", r"<<-?" + _HEREDOC), ("s", _interpolated(r"\$"))],
    "nix": [("c", _HASHES), ("c", _BLOCK), ("s", r"''[\s\S]*?(?:''(?!['$\\])|\Z)"), ("s", _LONG_DOUBLE)],
}
_OPENERS["typescript"] = _OPENERS["javascript"]
#: What nests: the text that opens and the one that shuts.
_NESTING = {"/*": "*/", "{-": "-}", "(*": "*)", "#=": "=#"}


@cache
def _opener(language: str | None) -> re.Pattern:
    rules = _OPENERS.get(language or "c", _OPENERS["c"])
    return re.compile("|".join(f"(?P<{what}{i if what in ('c', 's') else ''}>{pattern})" for i, (what, pattern) in enumerate(rules)), re.MULTILINE)


@cache
def _nest(opens: str) -> re.Pattern:
    return re.compile(f"({re.escape(opens)})|{re.escape(_NESTING[opens])}")


def _after_nested(source: str, at: int, opens: str) -> int:
    depth = 1
    for m in _nest(opens).finditer(source, at):
        depth += 1 if m[1] else -1
        if not depth:
            return m.end()
    return len(source)


def _divides(source: str, at: int, found: list[tuple[int, int, str]], ruby: bool) -> bool:
    """Whether a slash follows a value; comments in between don't count."""
    k, n = at, len(found)
    while True:
        while k and source[k - 1] in " \t\n":
            k -= 1
        if n and found[n - 1][1] == k and found[n - 1][2] == COMMENT:
            n, k = n - 1, found[n - 1][0]
            continue
        break
    if not k:
        return False
    if word := _WORD_BEFORE.search(source, max(0, k - 64), k):
        command = ruby and k < at and source[at + 1 : at + 2] not in ("", " ", "=")  # puts /x/
        return word[1] not in _BEFORE_REGEX and not command
    return source[k - 1] in ")]}\"'`"


def spans(source: str, language: str | None) -> list[tuple[int, int, str]]:
    """(start, end, comment or string) of what isn't code, in order."""
    search, found, at = _opener(language).search, [], 0
    if language == "php" and (at := max(source.find("<?"), 0)):
        found.append((0, at, STRING))
    templates: list[int] = []  # open braces inside each template string that an expression is in
    heredocs: list[tuple[str, bool]] = []  # those that begin on the next line: their last line, and whether it may be indented

    def template(begin: int, k: int) -> int:
        """Where the template string from ``begin`` ends or its next expression begins; ``k`` is behind its first mark."""
        for m in _TEMPLATE.finditer(source, k):
            if m[0] == "`" or m[0] == "${":
                found.append((begin, m.end(), STRING))
                if m[0] != "`":
                    templates.append(0)
                return m.end()
        found.append((begin, len(source), STRING))
        return len(source)

    while True:
        m = search(source, at)
        if heredocs:
            line = source.find("\n", at)
            line = len(source) if line < 0 else line
            if m is None or m.start() >= line:
                at = line
                for last, loose in heredocs:
                    shut = re.compile(rf"^{'[ \t]*' if loose else ''}{re.escape(last)}\b", re.MULTILINE).search(source, at + 1)
                    stop = shut.end() if shut else len(source)
                    if stop > at + 1:
                        found.append((at + 1, stop, STRING))
                    at = stop
                heredocs = []
                continue
        if m is None:
            return found
        what, start, end = m.lastgroup, m.start(), m.end()
        if what[0] == "c":
            found.append((start, end, COMMENT))
        elif what == "nested":
            end = _after_nested(source, end, m[0])
            found.append((start, end, COMMENT))
        elif what == "template":
            end = template(start, end)
        elif what == "brace":
            if templates and m[0] == "{":
                templates[-1] += 1
            elif templates and templates[-1]:
                templates[-1] -= 1
            elif templates:
                templates.pop()
                end = template(start, end)
        elif what == "regex":
            body = None if _divides(source, start, found, language == "ruby") else _REGEX_BODY.match(source, start)
            if body:
                end = body.end()
                found.append((start, end, STRING))
        elif what == "heredoc":
            heredocs.append((m["hd"], language == "php" or "-" in m[0] or "~" in m[0]))
            if m["hq"]:
                found.append((start, end, STRING))
        elif end > start:
            found.append((start, end, STRING))
        at = end if end > start else start + 1


def blanked(source: str, found: list[tuple[int, int, str]]) -> str:
    """The source with spaces for what isn't code; line ends stay, so do all places."""
    parts, at = [], 0
    for start, end, _ in found:
        piece = source[start:end]
        parts += [source[at:start], _GAP.sub(" ", piece) if "\n" in piece else " " * len(piece)]
        at = end
    return "".join([*parts, source[at:]])
