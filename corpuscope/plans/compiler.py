"""A query's tree as Spark columns.

Leaves are two-valued, so NOT is exact. A text term has a test on a whole text, which comes first where a match in the
text implies one in a line, a test on one line, and a test on a path.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuscope.functions import dates, languages
from corpuscope.functions.patterns import EXACT, FOLD, WORD_CHAR, folded, holds_text, path_glob, quoted, regex, word_edges
from corpuscope.plans.query import Node, Query


def true_() -> Column:
    return F.lit(True)


def yes(column: Column) -> Column:
    """Null counts as false."""
    return F.coalesce(column, F.lit(False))


def any_of(columns) -> Column:
    return reduce(lambda a, b: a | b, columns, F.lit(False))


def all_of(columns) -> Column:
    return reduce(lambda a, b: a & b, columns, F.lit(True))


def text_lines(content: Column) -> Column:
    """A text's lines: cut at \\n, without a carriage return at their end; a final line end opens no line."""
    lines = F.split(content, "\n", -1)
    lines = F.when(content.endswith("\n"), F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0)))).otherwise(lines)
    return F.when(F.contains(content, F.lit("\r")), F.transform(lines, lambda x: F.regexp_replace(x, "\r\\z", ""))).otherwise(lines)


def truth(node: Node | None, leaf) -> Column:
    if node is None:
        return true_()
    if node.kind == "and":
        return all_of([truth(k, leaf) for k in node.kids])
    if node.kind == "or":
        return any_of([truth(k, leaf) for k in node.kids])
    if node.kind == "not":
        return ~truth(node.kids[0], leaf)
    return yes(leaf(node))


def condition(node: Node, leaf) -> Column:
    """A conjunct as a filter. A leaf stays bare: a filter drops null as it drops false, and a bare comparison reaches the scan."""
    return leaf(node) if node.kind in ("text", "op") else truth(node, leaf)


def contributing(node: Node | None, leaf, term_of, above: Column | None = None) -> dict[int, Column]:
    """For each term when it made the predicate true: under a true AND all do, under OR the true arms, under NOT none."""
    above = true_() if above is None else above
    if node is None or node.kind == "not":
        return {}
    if node.kind in ("and", "or"):
        here = above & truth(node, leaf)
        out: dict[int, Column] = {}
        for k in node.kids:
            out |= contributing(k, leaf, term_of, here)
        return out
    return {node.term: above & yes(leaf(node))} if term_of(node) else {}


@dataclass
class Settings:
    """What changes results besides the query; names follow the query's own options."""

    now: datetime = datetime(2026, 10, 3, 10)
    case: str = "smart"
    word: str = "no"
    match: str = "exact"
    count: int = 200
    order: str = "best"
    context: int = 0
    vendored: tuple[str, ...] | None = None
    generated: tuple[str, ...] | None = None


class Terms:
    """How the terms of a query match."""

    def __init__(self, query: Query, settings: Settings):
        self.query, self.settings = query, settings
        mode = query.options.get("case", settings.case)
        self.exact = mode == "yes" or (mode == "smart" and any(self._capital(n) for n in query.root.walk() if n.kind == "text" or n.term >= 0)) if query.root else False
        self.whole = query.options.get("word", settings.word) == "yes"

    @staticmethod
    def _capital(node: Node) -> bool:
        return regex(node.value).capital if node.form == "regex" else node.value != node.value.lower()

    def java(self, node: Node) -> str:
        """The Java pattern of a term."""
        if node.form == "regex":
            body = regex(node.value).java
            # an edge counts only where the match itself has a word character there
            ahead, behind = f"(?![{WORD_CHAR}])", f"(?<![{WORD_CHAR}])"
            body = f"(?:{behind}|{ahead})(?:{body})(?:{ahead}|{behind})" if self.whole else body
        else:
            spelled = quoted if self.exact or node.op == "ref" else folded
            body = word_edges(node.value, spelled) if self.whole or node.op == "ref" else spelled(node.value)
        return (EXACT if self.exact or node.op == "ref" else FOLD) + body

    def plain(self, node: Node) -> bool:
        return node.form != "regex" and not self.whole and node.op != "ref"

    def in_line(self, node: Node, line: Column) -> Column:
        """Whether a line has a match that is not empty."""
        if self.plain(node):
            return holds_text(line, node.value, self.exact)
        if node.form == "regex" and regex(node.value).nullable:
            return F.exists(F.regexp_extract_all(line, F.lit(self.java(node)), F.lit(0)), lambda m: m != "")
        return line.rlike(self.java(node))

    def in_text(self, node: Node, content: Column) -> Column:
        """Whether some line has a match."""
        if self.plain(node) and "\n" not in node.value:
            return holds_text(content, node.value, self.exact)
        whole = node.form != "regex" or regex(node.value).whole_text_is_safe
        if whole and not self.whole:
            return content.rlike(self.java(node))
        gate = self._gate(node, content)
        return gate & F.exists(text_lines(content), lambda line: self.in_line(node, line))

    def _gate(self, node: Node, content: Column) -> Column:
        """A cheap test that every text with a match passes: it has the literal that all matches hold."""
        need = node.value if node.form != "regex" else regex(node.value).required
        return holds_text(content, need, self.exact) if need else true_()

    def in_path(self, node: Node, path: Column) -> Column:
        return holds_text(path, node.value, self.exact) if self.plain(node) else path.rlike(self.java(node))

    def fuzzy(self, node: Node, path: Column) -> Column:
        """The word's letters in order within the file's name, the first at the start of a word."""
        letters = [quoted(c) for c in node.value if not c.isspace()]
        start = rf"(?:^|[^{WORD_CHAR}]|_|(?<=[\p{{Ll}}\p{{Nd}}])(?=\p{{Lu}}))"
        return languages.base_name(path).rlike(FOLD + start.replace("(?iud)", "") + ".*?".join(letters)) if letters else F.lit(False)

    def path_value(self, node: Node, path: Column) -> Column:
        """file: and repo: values: a regular expression, a glob, or a literal in quotes."""
        if node.form == "phrase":
            return holds_text(path, node.value, self.exact)
        flags = EXACT if self.exact else FOLD
        return path.rlike(flags + (path_glob(node.value) if node.form == "glob" else regex(node.value).java))

    def window(self, node: Node) -> datetime:
        now = self.settings.now
        return dates.since(now, node.value) if node.op == "since" else dates.until(now, node.value)


def conjuncts(root: Node | None) -> list[Node]:
    return [] if root is None else root.kids if root.kind == "and" else [root]


#: Conjuncts that can hide results, and the reason that the note on them gives.
def filter_reason(node: Node) -> str | None:
    if node.kind == "not":
        return "pathFilter" if node.kids[0].op == "file" else "not"
    return {"since": "since", "until": "since", "kind": "kind", "owner": "owner"}.get(node.op) if node.kind == "op" else None
