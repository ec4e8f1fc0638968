"""What a text's syntax decides: comments and strings, structural templates, spans of matches, definitions.

These need a scanner, so they run in Arrow-batched functions, behind cheap tests in the plan.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.functions.patterns import python_pattern

# Per language the marks of line comments, block comments, and strings.
SYNTAX = """
python; #; ; \"\"\" ''' " '
typescript javascript; //; /* */; ` " '
go; //; /* */; ` " '
c c++ java kotlin csharp swift scala rust dart php protobuf; //; /* */; " '
css; ; /* */; " '
ruby perl r elixir shell yaml toml make docker cmake; #; ; " '
sql lua haskell; --; /* */; " '
html markdown; ; <!-- -->;
json; ; ; "
"""


@lru_cache
def _scanner(lang: str):
    for row in SYNTAX.strip().splitlines():
        names, line, block, strings = (x.strip() for x in row.split(";", 3))
        if lang in names.split():
            parts = [f"(?P<s{k}>{re.escape(q)}(?:\\\\.|(?!{re.escape(q)}){'[\\s\\S]' if len(q) == 3 or q == '`' else '[^\\n]'})*(?:{re.escape(q)})?)" for k, q in enumerate(strings.split())]
            if block:
                a, b = block.split()
                parts.append(f"(?P<b>{re.escape(a)}[\\s\\S]*?(?:{re.escape(b)}|\\Z))")
            if line:
                parts.append(f"(?P<l>{re.escape(line)}[^\\n]*)")
            return re.compile("|".join(parts)) if parts else None
    return None


def places(content: str, lang: str) -> list[tuple[str, int, int]]:
    """The comments and strings of a text: (kind, start, end). The rest is code; a language not known is all code."""
    scan = _scanner(lang or "")
    return [] if scan is None else [("strings" if m.lastgroup.startswith("s") else "comments", m.start(), m.end()) for m in scan.finditer(content)]


def place_of(regions: list[tuple[str, int, int]], start: int, end: int) -> str:
    """Where a match lies; one that crosses an edge lies in none."""
    for kind, a, b in regions:
        if a <= start and end <= b:
            return kind
        if start < b and a < end:
            return "across"
    return "code"


_TOKEN = re.compile(r"[^\W\d]\w*|\d[\w.]*|\s+|.", re.S)
_OPEN, _CLOSE = "([{", ")]}"
#: In marked-up text a bracket is a character of the text like any other and need not have a partner.
_UNPAIRED = ("html", "markdown", "text")


def _tokens(text: str, lang: str | None = None) -> list[tuple[str, int, int]]:
    """Words, numbers and single marks with places; comments are left out and strings are one token each."""
    out, at = [], 0
    for kind, a, b in [*(places(text, lang) if lang else []), ("", len(text), len(text))]:
        out += [(m[0], m.start(), m.end()) for m in _TOKEN.finditer(text, at, a) if not m[0].isspace()]
        if kind == "strings":
            out.append((text[a:b], a, b))
        at = b
    return out


@lru_cache
def template(source: str) -> tuple:
    """A template's parts: tokens, and holes as (name,)."""
    parts, at = [], 0
    for m in re.finditer(r":\[(\w*)\]", source):
        parts += [t for t, _, _ in _tokens(source[at : m.start()])]
        parts.append((m[1],))
        at = m.end()
    return tuple(parts + [t for t, _, _ in _tokens(source[at:])])


def find_structures(text: str, lang: str, source: str, budget: int | None = None) -> tuple[list[tuple[int, int]], bool]:
    """Where a template matches, leftmost and without overlap, and whether the search was complete. A hole takes a shortest run of tokens, in code
    with balanced brackets; the same name takes the same tokens; ``_`` and no name bind nothing. The search has ``budget`` steps, or 2,000,000
    and 64 for each token."""
    parts, tokens = template(source), _tokens(text, lang)
    words = [t for t, _, _ in tokens]
    opening, closing = ("", "") if lang in _UNPAIRED else (_OPEN, _CLOSE)
    left = [2_000_000 + 64 * len(words) if budget is None else budget]

    def match(p: int, at: int, bound: dict) -> int | None:
        left[0] -= 1
        if left[0] < 0:
            return None
        if p == len(parts):
            return at
        part = parts[p]
        if isinstance(part, str):
            return match(p + 1, at + 1, bound) if at < len(words) and words[at] == part else None
        name = part[0]
        if name in bound:
            run = bound[name]
            return match(p + 1, at + len(run), bound) if words[at : at + len(run)] == run else None
        depth, end = 0, at
        while True:
            if depth == 0:
                got = match(p + 1, end, bound if name in ("", "_") else {**bound, name: words[at:end]})
                if got is not None:
                    return got
            if end >= len(words) or left[0] < 0:
                return None
            depth += (words[end] in opening) - (words[end] in closing) if len(words[end]) == 1 else 0
            if depth < 0:
                return None
            end += 1

    found, at = [], 0
    first = parts[0] if parts and isinstance(parts[0], str) else None
    while at < len(words) and parts:
        end = match(0, at, {}) if first is None or words[at] == first else None
        if end is not None and end > at:
            found.append((tokens[at][1], tokens[end - 1][2]))
            at = end
        else:
            at += 1
    return found, left[0] >= 0


#: Further lines shown of a match over line ends.
MOST_SHOWN = 10
#: Matches marked in a line; characters a line is cut to, and how many of them stand before the first match.
MOST_HITS, CLIPPED, LEAD = 800, 400, 80
SPANS = "array<struct<start:int,end:int>>"


def hole_text(code: str, most: int = 80) -> str:
    """What a hole took, as a result lists it: runs of space as one, at most ``most`` characters."""
    text = " ".join(code.split())
    return text if len(text) <= most else text[: most - 1] + "\u2026"


def searched_column(content: Column, lang: Column, source: str) -> Column:
    """The ``spans`` of a template in a text, empty where the template's words are not all in it, and whether the search was ``complete``."""
    @F.pandas_udf(f"spans {SPANS}, complete boolean")
    def find(texts: pd.Series, langs: pd.Series) -> pd.DataFrame:
        found = [find_structures(t, x or "", source) if t else ([], True) for t, x in zip(texts, langs, strict=True)]
        return pd.DataFrame({"spans": [[{"start": a, "end": b} for a, b in spans] for spans, _ in found], "complete": [c for _, c in found]})

    words = [p for p in template(source) if isinstance(p, str) and re.match(r"\w", p)]
    gate = F.lit(True)
    for w in words:
        gate = gate & F.contains(content, F.lit(w))
    return find(F.when(gate, content), lang)


def find_column(content: Column, lang: Column, source: str) -> Column:
    return searched_column(content, lang, source)["spans"]


def structure_lines(search, node, facts) -> DataFrame:
    """Lines on which a template's matches begin, with the lines they cover. Each text is searched once: what has no match has no rows."""
    carried = [c.alias(name) for name, c in facts.items()]
    df = search.matching(leave=node).select("repo", "repo_ord", "path", "lang", *carried, "content", F.explode(find_column(F.col("content"), F.col("lang"), node.value)).alias("m"))
    begin = F.length(F.regexp_replace(F.substring(F.col("content"), F.lit(1), F.col("m.start")), "[^\n]", "")) + 1
    return df.select("repo", "repo_ord", "path", "lang", *facts, begin.alias("line"), F.expr("substring(content, m.start + 1, m.end - m.start)").alias("text"))


def matches_in(content: Column, lang: Column, java_pattern: str, kinds: tuple[str, ...], left_out: tuple[str, ...] = ()) -> Column:
    """The matches of a pattern that lie in the wanted places. Prose languages have no places: they keep all."""
    python = python_pattern(java_pattern)

    @F.pandas_udf(SPANS)
    def keep(texts: pd.Series, langs: pd.Series) -> pd.Series:
        out = []
        for text, x in zip(texts, langs, strict=True):
            spans = []
            if text:
                regions = None
                for m in python.finditer(text):
                    if m.end() > m.start():
                        regions = places(text, x) if regions is None else regions
                        where = place_of(regions, m.start(), m.end())
                        if (not kinds or where in kinds or x in ("markdown", "text")) and where not in left_out:
                            spans.append({"start": m.start(), "end": m.end()})
            out.append(spans)
        return pd.Series(out)

    return keep(F.when(content.rlike(java_pattern), content), lang)


def multiline_spans(text: str, pattern: re.Pattern) -> list[tuple[int, int, int, int]]:
    """Matches over line ends as (start, end, first line, last line), joined where their lines overlap."""
    out: list[list[int]] = []
    plain = text.replace("\r\n", "\n")
    for m in pattern.finditer(plain):
        if m.end() == m.start():
            continue
        first = plain.count("\n", 0, m.start()) + 1
        last = first + plain.count("\n", m.start(), m.end() - 1)
        if out and first <= out[-1][3]:
            out[-1][1], out[-1][3] = m.end(), max(out[-1][3], last)
        else:
            out.append([m.start(), m.end(), first, last])
    return [tuple(x) for x in out]


# How definitions begin, by language: kind and pattern with the name as its group.
DEFINITIONS = {
    "python": [("class", r"^\s*class\s+(\w+)"), ("function", r"^\s*(?:async\s+)?def\s+(\w+)")],
    "go": [("method", r"^func\s+\([^)]*\)\s*(\w+)"), ("function", r"^func\s+(\w+)"), ("interface", r"^type\s+(\w+)\s+interface\b"), ("type", r"^type\s+(\w+)")],
    "rust": [("function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*fn\s+(\w+)"), ("interface", r"^\s*(?:pub\s+)?trait\s+(\w+)"), ("class", r"^\s*(?:pub\s+)?(?:struct|enum)\s+(\w+)"), ("type", r"^\s*(?:pub\s+)?type\s+(\w+)")],
    "ruby": [("class", r"^\s*class\s+(\w+)"), ("other", r"^\s*module\s+(\w+)"), ("function", r"^\s*def\s+(?:self\.)?(\w+[?!]?)")],
    "shell": [("function", r"^\s*(?:function\s+)?(\w+)\s*\(\)")],
    "javascript": [("class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)"), ("interface", r"^\s*(?:export\s+)?interface\s+(\w+)"), ("type", r"^\s*(?:export\s+)?type\s+(\w+)\s*="), ("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)"), ("function", r"^\s*(?:export\s+)?const\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>")],
    "java": [("class", r"^\s*(?:\w+\s+)*(?:class|enum|record)\s+(\w+)"), ("interface", r"^\s*(?:\w+\s+)*interface\s+(\w+)"), ("method", r"^\s+(?:(?:public|private|protected|static|final|abstract|override|async)\s+)+[\w<>\[\],. ]+\s+(\w+)\s*\(")],
    "html": [("other", r"<h[1-6][^>]*>([^<]+)")],
    "markdown": [("other", r"^#{1,6}\s+(.+?)\s*$")],
}
_SAME = {"typescript": "javascript", "csharp": "java", "kotlin": "java", "scala": "java", "swift": "java", "php": "java", "c": "java", "c++": "java"}
SYMBOLS = "array<struct<name:string,kind:string,line:int,end:int>>"


def definitions(content: str, lang: str) -> list[dict]:
    """Definitions with first and last line, found on lines with comments and strings blanked. A body ends with its brackets, or where the
    indentation goes back."""
    rules = DEFINITIONS.get(_SAME.get(lang, lang))
    if not rules or not content:
        return []
    if lang == "html":
        # a page is often one line, and a heading may cross lines
        out, line, at = [], 1, 0
        for m in re.finditer(rules[0][1], content, re.I):
            line, at = line + content.count("\n", at, m.start()), m.start()
            out.append({"name": m[1], "kind": rules[0][0], "line": line, "end": line})
        return out
    masked = content
    if lang not in ("html", "markdown"):
        for _, a, b in places(content, lang):
            masked = masked[:a] + re.sub(r"[^\n]", " ", masked[a:b]) + masked[b:]
    lines, out = masked.split("\n"), []
    compiled = [(kind, re.compile(p)) for kind, p in rules]
    for i, line in enumerate(lines):
        for kind, pattern in compiled:
            m = pattern.search(line)
            if m:
                end = _body_end(lines, i, lang)
                inside = kind == "function" and any(d["kind"] in ("class", "interface") and d["line"] <= i + 1 <= d["end"] for d in out)
                out.append({"name": m[1], "kind": "method" if inside else kind, "line": i + 1, "end": end})
                break
    return out


def _body_end(lines: list[str], i: int, lang: str) -> int:
    if lang in ("html", "markdown"):
        return i + 1
    indent = len(lines[i]) - len(lines[i].lstrip())
    if lang in ("python", "ruby"):
        last = i
        for k in range(i + 1, len(lines)):
            if lines[k].strip():
                deep = len(lines[k]) - len(lines[k].lstrip())
                if deep <= indent:
                    return k + 1 if lang == "ruby" and lines[k].strip() == "end" else last + 1
                last = k
        return last + 1
    depth, seen = 0, False
    for k in range(i, len(lines)):
        depth += lines[k].count("{") - lines[k].count("}")
        seen = seen or "{" in lines[k]
        if seen and depth <= 0:
            return k + 1
        if not seen and (lines[k].rstrip().endswith(";") or k > i + 5):
            return i + 1
    return len(lines)


def symbols_column(content: Column, lang: Column) -> Column:
    @F.pandas_udf(SYMBOLS)
    def extract(texts: pd.Series, langs: pd.Series) -> pd.Series:
        return pd.Series([definitions(t or "", x or "") for t, x in zip(texts, langs, strict=True)])

    return extract(content, lang)


def outline(content: str, lang: str, most: int = 1000) -> list[dict]:
    """Definitions with ``depth``: how many others they lie in."""
    found = definitions(content, lang)[:most]
    return [d | {"depth": sum(o is not d and o["line"] <= d["line"] and d["end"] <= o["end"] and (o["line"], -o["end"]) < (d["line"], -d["end"]) for o in found)} for d in found]


def fuzzy_score(name: str, word: str) -> int | None:
    """The best score of a word's letters in order within a name, the first at a word's start: 1 a letter, 8 at a word's start, 4 right after the last,
    -1 for a gap. None if they do not occur."""
    low, want = name.lower(), word.lower()
    start = [i == 0 or not name[i - 1].isalnum() or (name[i].isupper() and not name[i - 1].isupper()) for i in range(len(name))]
    best: dict[int, int] = {}
    for k, c in enumerate(want):
        now: dict[int, int] = {}
        for i, x in enumerate(low):
            if x != c or (k == 0 and not start[i]):
                continue
            own = 1 + 8 * start[i]
            if k == 0:
                now[i] = own
            else:
                before = [s + (4 if j == i - 1 else -1) for j, s in best.items() if j < i]
                if before:
                    now[i] = max(before) + own
        best = now
    return max(best.values(), default=None)


def multiline_lines(search, terms, facts) -> DataFrame:
    """Matches over line ends, each on its first line, joined where their lines overlap, with up to ``MOST_SHOWN`` further lines."""
    patterns = [python_pattern(search.terms.java(n).replace("\\z", "$"), multiline=True) for n in terms]

    @F.pandas_udf("array<struct<line:int,text:string>>")
    def find(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            rows = []
            lines = (text or "").replace("\r\n", "\n").split("\n")
            for p in patterns:
                rows += [{"line": a, "text": "\n".join(lines[a - 1 : min(b, a + MOST_SHOWN)])} for _, _, a, b in multiline_spans(text or "", p)]
            out.append(rows)
        return pd.Series(out)

    carried = [c.alias(name) for name, c in facts.items()]
    df = search.matching().select("repo", "repo_ord", "path", "lang", *carried, F.explode(find("content")).alias("m"))
    return df.select("repo", "repo_ord", "path", "lang", *facts, "m.line", "m.text")


def highlight_column(text: Column, terms: list[tuple[int, str]]) -> Column:
    """All matches of terms (number, Java pattern) in a line as UTF-16 spans, and the line cut to ``CLIPPED`` characters from ``LEAD`` before the first match."""
    compiled = [(k, python_pattern(p)) for k, p in terms]

    @F.pandas_udf("struct<hits:array<struct<start:int,end:int,term:int>>,clipped:string>")
    def run(lines: pd.Series) -> pd.DataFrame:
        hits, clipped = [], []
        for line in lines:
            found = [] if line is None else sorted((m.start(), m.end(), k) for k, p in compiled for m in p.finditer(line) if m.end() > m.start())
            wide = (lambda i, x=line: i) if line is None or line.isascii() else (lambda i, x=line: len(x[:i].encode("utf-16-le")) // 2)
            hits.append([{"start": wide(a), "end": wide(b), "term": k} for a, b, k in found[:MOST_HITS]])
            if line is not None and len(line) > CLIPPED:
                begin = max(0, (found[0][0] if found else 0) - LEAD)
                line = ("\u2026" if begin else "") + line[begin : begin + CLIPPED] + ("\u2026" if begin + CLIPPED < len(line) else "")
            clipped.append(line)
        return pd.DataFrame({"hits": hits, "clipped": clipped})

    return run(text)
