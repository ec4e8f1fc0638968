"""Search patterns: the RE2 dialect checked and rewritten for Spark's Java regular expressions, literals, globs.

Patterns are handled on the driver; executors see plain ``rlike`` and ``contains``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import regex as regex_module
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java's plain case-insensitive mode folds ASCII only; with ``u`` it folds as RE2 does. ``d`` makes \n the only line end.
FOLD, EXACT = "(?iud)", "(?d)"
_ASCII_WORD = "[0-9A-Za-z_]"
#: The edges of a whole word: letters, digits and the underscore of any script go on.
WORD_CHAR = r"\p{L}\p{Nd}_"
_SPACE_CLASS = r"\t\n\f\r "


class BadPattern(ValueError):
    """The pattern is not valid RE2."""


@dataclass(frozen=True)
class Pattern:
    """A checked regular expression.

    ``java``: its Java spelling. ``anchored``: it has anchors, so what matches in a line need not match in the text around
    it. ``newline``: a match may hold a line end. ``nullable``: it matches the empty text. ``capital``: a literal capital
    stands in it. ``required``: a text that every match holds, or empty.
    """

    source: str
    java: str
    anchored: bool
    newline: bool
    nullable: bool
    capital: bool
    required: str

    @property
    def whole_text_is_safe(self) -> bool:
        """A match in the text implies one in some line."""
        return not (self.anchored or self.newline or self.nullable)


@lru_cache(maxsize=256)
def python_pattern(java: str, multiline: bool = False):
    """The Java spelling of a checked pattern for Python, by the ``regex`` module, which has ``\\p`` classes and the same groups."""
    flags = re.match(r"\(\?([a-z]+)\)", java)
    body = java[flags.end() :] if flags else java
    wide = regex_module.I if flags and "i" in flags[1] else 0
    return regex_module.compile(body.replace("\\z", "\\Z"), regex_module.V0 | wide | (regex_module.M if multiline else 0))


def quoted(text: str) -> str:
    """The pattern of a literal text."""
    return re.sub(r"([\\.+*?()|\[\]{}^$#&~\-])", r"\\\1", text)


def folded(text: str) -> str:
    """The pattern of a literal text that ignores case. Java takes the Turkish dotless and dotted i for the plain one, which RE2 does not."""
    return re.sub("[iI\u0131\u0130]", lambda m: f"(?-i:{'[iI]' if m[0] in 'iI' else m[0]})", quoted(text))


def regex(source: str) -> Pattern:
    """Checks RE2 syntax and rewrites what Java reads differently.

    Refused: look-around, back-references, possessive and atomic forms, counts over 1,000. Rewritten: ``\\b`` and
    ``\\B`` (ASCII in RE2), ``\\s`` (no vertical tab), ``\\z`` and a plain ``$`` (end of text only), ``(?P<n>``, ``(?U)``.
    """
    out: list[str] = []
    runs, run = [""], ""
    anchored = newline = capital = False
    depth, multi, dot_all, branched = 0, False, False, False
    i, n, atom = 0, len(source), False

    def literal(c: str):
        nonlocal run, capital
        if depth == 0:
            run += c
        capital = capital or (c.isalpha() and c != c.lower())

    def cut(drop_last: bool = False):
        nonlocal run
        runs.append(run[:-1] if drop_last else run)
        run = ""

    while i < n:
        c = source[i]
        if c == "\\":
            if i + 1 >= n:
                raise BadPattern("a backslash ends the pattern")
            e = source[i + 1]
            i += 2
            atom = True
            if e.isdigit() and e != "0":
                raise BadPattern(f"\\{e}: back-references are not supported")
            if e in "bB":
                anchored = True
                same = f"(?:(?<={_ASCII_WORD})(?={_ASCII_WORD})|(?<!{_ASCII_WORD})(?!{_ASCII_WORD}))"
                edge = f"(?:(?<={_ASCII_WORD})(?!{_ASCII_WORD})|(?<!{_ASCII_WORD})(?={_ASCII_WORD}))"
                out.append(edge if e == "b" else same)
                cut()
            elif e in "Az":
                anchored = True
                out.append("\\" + e)
                cut()
            elif e in "ZGkXR":
                raise BadPattern(f"\\{e}: unknown escape")
            elif e in "dDwW":
                newline = newline or e in "DW"
                out.append("\\" + e)
                cut()
            elif e in "sS":
                newline = newline or e == "s"
                out.append(f"[{_SPACE_CLASS}]" if e == "s" else f"[^{_SPACE_CLASS}]")
                cut()
            elif e in "pP":
                m = re.compile(r"\{(\^?)([A-Za-z_]+)\}|([A-Za-z])").match(source, i)
                if not m:
                    raise BadPattern(f"\\{e}: unknown character class")
                newline = newline or e == "P" or bool(m[1])
                name = m[2] or m[3]
                negated = (e == "P") != bool(m[1])
                out.append(("\\P" if negated else "\\p") + "{" + (f"Is{name}" if len(name) > 2 else name) + "}")
                i = m.end()
                cut()
            elif e == "Q":
                end = source.find("\\E", i)
                text = source[i:] if end < 0 else source[i:end]
                i = n if end < 0 else end + 2
                out.append(quoted(text))
                for x in text:
                    literal(x)
                newline = newline or "\n" in text
            elif e == "x":
                m = re.compile(r"\{([0-9A-Fa-f]+)\}|([0-9A-Fa-f]{2})").match(source, i)
                if not m:
                    raise BadPattern("\\x: bad escape")
                i = m.end()
                code = int(m[1] or m[2], 16)
                newline = newline or code == 10
                out.append(f"\\x{{{code:x}}}")
                literal(chr(code))
            elif e in "nrtfav":
                newline = newline or e == "n"
                out.append({"v": "\\x0B", "a": "\\x07"}.get(e, "\\" + e))
                literal({"n": "\n", "r": "\r", "t": "\t", "f": "\f", "a": "\a", "v": "\v"}[e])
            elif e == "C" or e.isalnum():
                raise BadPattern(f"\\{e}: unknown escape")
            else:
                out.append("\\" + e)
                literal(e)
            continue
        if c == "[":
            text, i, wide, has_capital = _char_class(source, i)
            out.append(text)
            newline, capital, atom = newline or wide, capital or has_capital, True
            cut()
            continue
        if c == "(":
            cut()
            if source.startswith("(?", i):
                m = re.compile(r"\(\?(?:P?<([A-Za-z_]\w*)>|([imsU]*(?:-[imsU]+)?)([:)]))").match(source, i)
                if not m:
                    raise BadPattern(f"{source[i : i + 4]}: look-around and atomic groups are not supported")
                i = m.end()
                if m[1]:
                    out.append(f"(?<{m[1].replace('_', 'U')}>")
                    depth += 1
                else:
                    if "U" in m[2]:
                        raise BadPattern("(?U): swapped greed is not supported")
                    on = m[2].split("-")[0]
                    multi, dot_all = multi or "m" in on, dot_all or "s" in on
                    out.append(f"(?{m[2].replace('i', 'iu', 1) if 'i' in on else m[2]}{m[3]}")
                    depth += m[3] == ":"
            else:
                out.append("(")
                depth += 1
                i += 1
            atom = False
            continue
        if c == ")":
            if depth == 0:
                raise BadPattern("unexpected )")
            depth -= 1
            run = ""
            out.append(c)
            atom = True
        elif c == "|":
            branched = branched or depth == 0
            cut()
            out.append(c)
            atom = False
        elif c in "*+?" or (c == "{" and re.compile(r"\{\d+(?:,\d*)?\}").match(source, i)):
            m = re.compile(r"[*+?]|\{(\d+)(?:,(\d*))?\}").match(source, i)
            if not atom:
                raise BadPattern(f"missing argument to repetition operator: {m[0]}")
            if max(int(m[1] or 0), int(m[2] or 0)) > 1000:
                raise BadPattern(f"invalid repeat count: {m[0]}")
            i = m.end()
            out.append(m[0])
            if i < n and source[i] == "?":
                out.append("?")
                i += 1
            if i < n and source[i] in "*+?":
                raise BadPattern(f"invalid nested repetition operator: {m[0]}{source[i]}")
            cut(drop_last=m[0] != "+" and not (m[1] and int(m[1])))
            atom = False
            continue
        elif c == "^" or c == "$":
            anchored = True
            out.append(c if c == "^" or multi else "\\z")
            cut()
            atom = True
        elif c == ".":
            newline = newline or dot_all
            out.append(c)
            cut()
            atom = True
        else:
            out.append("\\" + c if c in "{}]" else c)
            literal(c)
            newline = newline or c == "\n"
            atom = True
        i += 1
    if depth:
        raise BadPattern("missing closing )")
    cut()
    java = "".join(out)
    try:
        nullable = bool(re.compile(re.sub(r"\(\?<(?![=!])", "(?P<", java).replace("\\z", "\\Z") if "\\p" not in java and "\\P" not in java and "\\x{" not in java else "(?!)").match(""))
    except re.error:
        nullable = False
    required = "" if branched else max((r for r in runs if "\n" not in r), key=len, default="")
    return Pattern(source, java, anchored, newline, nullable, capital, required)


def _char_class(source: str, i: int) -> tuple[str, int, bool, bool]:
    """A bracket class from ``source[i]``: its Java spelling, the index after it, whether it holds \\n, whether a capital
    stands in it."""
    j, out, negated, wide, capital = i + 1, ["["], False, False, False
    if source.startswith("^", j):
        negated, j = True, j + 1
        out.append("^")
    first = True
    while True:
        if j >= len(source):
            raise BadPattern("missing closing ]")
        c = source[j]
        if c == "]" and not first:
            break
        first = False
        if source.startswith("[:", j):
            m = re.compile(r"\[:(\^?)([a-z]+):\]").match(source, j)
            names = {"alpha": "Alpha", "digit": "Digit", "alnum": "Alnum", "upper": "Upper", "lower": "Lower", "punct": "Punct", "space": "Space", "xdigit": "XDigit", "blank": "Blank", "cntrl": "Cntrl", "graph": "Graph", "print": "Print", "ascii": "ASCII"}
            if not m or m[2] not in {*names, "word"}:
                raise BadPattern("invalid character class range")
            out.append(("\\W" if m[1] else "\\w") if m[2] == "word" else ("\\P{" if m[1] else "\\p{") + names[m[2]] + "}")
            wide = wide or bool(m[1]) or m[2] in ("space", "cntrl", "ascii")
            j = m.end()
        elif c == "\\":
            e = source[j + 1 : j + 2]
            if not e or (e.isalnum() and e not in "dDwWsSnrtfavxpP0123456789") or e == "b":
                raise BadPattern(f"\\{e}: unknown escape")
            wide = wide or e in "DWsn" or e == "P"
            if e in "sS":
                out.append(_SPACE_CLASS if e == "s" else f"&&[^{_SPACE_CLASS}]")
                j += 2
            elif e in "pPx":
                m = re.compile(r"\{[^}]*\}|[0-9A-Fa-f]{2}|[A-Za-z]").match(source, j + 2)
                if not m:
                    raise BadPattern(f"\\{e}: bad escape")
                out.append(f"\\{e}{m[0]}")
                j = m.end()
            else:
                out.append({"v": "\\x0B", "a": "\\x07"}.get(e, "\\" + e))
                j += 2
        else:
            out.append("\\" + c if c in "[&~^" or (c == "]") else c)
            wide, capital = wide or c == "\n", capital or (c.isalpha() and c != c.lower())
            j += 1
    out.append("]")
    return "".join(out), j + 1, wide != negated, capital


def glob_body(glob: str) -> str:
    """``**/`` any folders, ``**`` anything, ``*`` and ``?`` within a folder, ``\\x`` the character x."""
    out, i = [], 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif glob.startswith("**", i):
            out.append(".*")
            i += 2
        elif glob[i] == "*":
            out.append("[^/]*")
            i += 1
        elif glob[i] == "?":
            out.append("[^/]")
            i += 1
        elif glob[i] == "\\" and i + 1 < len(glob):
            out.append(quoted(glob[i + 1]))
            i += 2
        else:
            out.append(quoted(glob[i]))
            i += 1
    return "".join(out)


def path_glob(glob: str) -> str:
    """The pattern of a path glob: it starts at any folder and goes to the end of the path."""
    return "(?:^|/)" + glob_body(glob.removeprefix("^").removesuffix("$")) + "\\z"


def reads_as_glob(value: str, valid_regex: bool) -> bool:
    """A star at the start or after a character that repetition seldom follows; a question mark only where the value is
    no regular expression."""
    i = 0
    while i < len(value):
        if value[i] == "\\":
            i += 1
        elif value[i] == "*" and (i == 0 or value[i - 1] not in ".)]}"):
            return True
        elif value[i] == "?" and not valid_regex:
            return True
        i += 1
    return False


def owners_glob(pattern: str) -> str:
    """A CODEOWNERS pattern: a slash at the start or inside anchors it at the root, one at the end means the folder's
    contents, ``/*`` at the end means files of that folder only."""
    anchored = "/" in pattern.rstrip("/")
    body = glob_body(pattern.strip("/") if not pattern.endswith("/*") else pattern.lstrip("/"))
    tail = "/.*" if pattern.endswith("/") else "" if pattern.endswith("/*") else "(?:/.*)?"
    return ("^" if anchored else "(?:^|.*/)") + body + tail + "\\z"


def index_glob(pattern: str) -> str:
    """A pattern of ``index.exclude``: without a slash at any depth, with one from the top folder; a folder takes its contents."""
    body = pattern.rstrip("/") or pattern
    if body.startswith("./"):
        body = body[2:]
    elif body.startswith("/") and len(body) > 1:
        body = body[1:]
    elif "/" not in body:
        body = "**/" + body
    return "^" + glob_body(body) + "(?:/.*)?\\z"


def excludes_glob(pattern: str) -> str:
    """An editor's exclude pattern: braces and classes besides the stars, from the top folder, contents included."""
    out, i, depth = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "{":
            out.append("(?:")
            depth += 1
        elif c == "}" and depth:
            out.append(")")
            depth -= 1
        elif c == "," and depth:
            out.append("|")
        elif c == "[" and "]" in pattern[i:]:
            end = pattern.index("]", i)
            inner = pattern[i + 1 : end]
            out.append("[" + ("^" + inner[1:] if inner[:1] in ("!", "^") else inner) + "]")
            i = end
        elif pattern.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 2
        elif pattern.startswith("**", i):
            out.append(".*")
            i += 1
        else:
            out.append(glob_body(c))
        i += 1
    return "^" + "".join(out) + "(?:/.*)?\\z"


def word_edges(literal: str, spelled=quoted) -> str:
    """A literal as a whole word: an edge counts only where the literal itself ends in a word character. ``spelled`` makes its pattern."""
    is_word = lambda c: c == "_" or c.isalpha() or c.isdecimal()
    before = f"(?<![{WORD_CHAR}])" if literal and is_word(literal[0]) else ""
    after = f"(?![{WORD_CHAR}])" if literal and is_word(literal[-1]) else ""
    return before + spelled(literal) + after


def holds_text(text: Column, literal: str, exact: bool) -> Column:
    """Whether a text has a literal. Ignoring case folds as Unicode does, which lower() does not."""
    return F.contains(text, F.lit(literal)) if exact else text.rlike(FOLD + folded(literal))


def spans_lines(source: str) -> bool:
    """Whether a regular expression is written to match over line ends: it names one outside classes that leave it out."""
    return bool(re.search(r"(?<!\\)(?:\\\\)*\\n|\n", re.sub(r"\[\^[^\]]*\]", "", source)))
