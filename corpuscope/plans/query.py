"""The query language: text to a tree with diagnostics. Never fails; what can't be read is reported."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from corpuscope.functions import dates
from corpuscope.functions.languages import NAMES as LANGUAGE_NAMES
from corpuscope.functions.languages import nearest
from corpuscope.functions.patterns import BadPattern, reads_as_glob, regex

MOST_UNITS, MOST_DIAGNOSTICS, MOST_DEPTH, MOST_RESULTS = 1000, 100, 50, 50_000


@dataclass(frozen=True)
class Operator:
    """scope: "both", "files" or "commits"; reads: how the value is checked; a global stands once, at the top level."""

    name: str
    short: str = ""
    scope: str = "both"
    whole: bool = False
    reads: str = "text"
    values: tuple[str, ...] = ()


KINDS = ("class", "interface", "function", "method", "type", "other")
OPERATORS = {
    o.name: o
    for o in (
        Operator("file", "f", reads="path"),
        Operator("author", "a", "commits", reads="name"),
        Operator("since", reads="window"),
        Operator("until", reads="window"),
        Operator("symbol", "sym", "files"),
        Operator("kind", "", "files", reads="one", values=KINDS),
        Operator("ref", "", "files", reads="reference"),
        Operator("is", reads="one", values=("open", "changed", "test", "generated", "vendored")),
        Operator("owner", "", "files", reads="name"),
        Operator("content"),
        Operator("struct", "", "files", reads="template"),
        Operator("in", "", "files", True, "one", ("comments", "strings", "code")),
        Operator("language", "lang", reads="language"),
        Operator("repo", reads="path"),
        Operator("message", "msg", "commits"),
        Operator("type", "", "both", True, "one", ("file", "code", "commit", "added", "removed")),
        Operator("case", "", "both", True, "one", ("yes", "no", "smart")),
        Operator("word", "", "both", True, "one", ("yes", "no")),
        Operator("match", "", "both", True, "one", ("exact", "fuzzy")),
        Operator("excludes", "", "both", True, "one", ("yes", "no")),
        Operator("count", "", "both", True, "count"),
        Operator("order", "", "files", True, "one", ("best", "file", "file:asc", "file:desc", "recent", "recent:asc", "recent:desc")),
        Operator("at", "", "files", True, "revision"),
    )
}
_SPELLED = {s: o for o in OPERATORS.values() for s in (o.name, o.short) if s}
# Spellings no longer in use and the operators they meant.
RETIRED = dict(x.split("=") for x in "path=file d=since u=until s=symbol k=kind x=ref i=is l=language r=repo m=message t=type c=case w=word n=count o=order".split())
COMMIT_TYPES = ("commit", "added", "removed")


@dataclass
class Diagnostic:
    code: str
    start: int
    end: int
    message: str
    fix: str | None = None
    warning: bool = False


@dataclass
class Node:
    """kind: "text", "op", "and", "or" or "not". form: "word", "phrase", "regex" or "glob". Offsets are UTF-16 units."""

    kind: str
    start: int
    end: int
    kids: list[Node] = field(default_factory=list)
    op: str = ""
    value: str = ""
    form: str = "word"
    term: int = -1

    def walk(self):
        yield self
        for k in self.kids:
            yield from k.walk()

    def shape(self):
        """A compact form for tests."""
        if self.kind in ("and", "or", "not"):
            return (self.kind, *(k.shape() for k in self.kids))
        return f"{self.op + ':' if self.op else ''}{self.form[0]}[{self.value}]"


@dataclass
class Query:
    text: str
    root: Node | None
    diagnostics: list[Diagnostic]
    options: dict[str, str]
    left_out_places: tuple[str, ...] = ()
    terms: list[Node] = field(default_factory=list)

    @property
    def ok(self) -> bool:
        return all(d.warning for d in self.diagnostics)

    @property
    def commits(self) -> bool:
        return self.options.get("type") in COMMIT_TYPES or any(n.kind == "op" and OPERATORS[n.op].scope == "commits" for n in (self.root.walk() if self.root else ()))


@dataclass
class _Token:
    kind: str  # word, phrase, regex, op, (, ), and, or, not
    start: int
    end: int
    value: str = ""
    form: str = "word"
    op: str = ""


def units(text: str) -> int:
    return len(text.encode("utf-16-le", "surrogatepass")) // 2


class _Reader:
    def __init__(self, text: str):
        self.text, self.found = text, []

    def say(self, code: str, start: int, end: int, message: str, fix: str | None = None, warning: bool = False) -> None:
        if len(self.found) < MOST_DIAGNOSTICS:
            at = lambda k: units(self.text[:k])
            self.found.append(Diagnostic(code, at(start), at(end), message, fix, warning))

    def quoted(self, i: int) -> tuple[str, int]:
        """A quoted text from its opening quote."""
        out, j = [], i + 1
        while j < len(self.text):
            c = self.text[j]
            if c == "\\" and self.text[j + 1 : j + 2] in ('"', "\\"):
                out.append(self.text[j + 1])
                j += 2
            elif c == '"':
                return "".join(out), j + 1
            else:
                out.append(c)
                j += 1
        self.say("unclosed_quote", i, len(self.text), "The quote is not closed", self.text + '"')
        return "".join(out), j

    def slashed(self, i: int) -> tuple[str, int]:
        out, j = [], i + 1
        while j < len(self.text):
            c = self.text[j]
            if c == "\\" and j + 1 < len(self.text):
                out.append("/" if self.text[j + 1] == "/" else self.text[j : j + 2])
                j += 2
            elif c == "/":
                return "".join(out), j + 1
            else:
                out.append(c)
                j += 1
        self.say("unclosed_regex", i, len(self.text), "The regular expression is not closed", self.text + "/")
        return "".join(out), j

    def value(self, i: int) -> tuple[str, str, int]:
        if self.text[i : i + 1] == '"':
            v, j = self.quoted(i)
            return v, "phrase", j
        if self.text[i : i + 1] == "/" and re.compile(r"/(?:\\.|[^/\\])*/(?=[\s)]|$)").match(self.text, i):
            v, j = self.slashed(i)
            return v, "regex", j
        depth, j = 0, i
        while j < len(self.text) and not self.text[j].isspace():
            if self.text[j] == "(":
                depth += 1
            elif self.text[j] == ")":
                if depth == 0:
                    break
                depth -= 1
            j += 1
        return self.text[i:j], "word", j

    def tokens(self) -> list[_Token]:
        out, i, text = [], 0, self.text
        while i < len(text):
            c = text[i]
            if c.isspace():
                i += 1
            elif c in "()":
                out.append(_Token(c, i, i + 1))
                i += 1
            elif c == '"':
                v, j = self.quoted(i)
                out.append(_Token("phrase", i, j, v, "phrase"))
                i = j
            elif c == "/":
                v, j = self.slashed(i)
                out.append(_Token("regex", i, j, v, "regex"))
                i = j
            elif c == "-" and i + 1 < len(text) and not text[i + 1].isspace():
                out.append(_Token("not", i, i + 1))
                i += 1
            else:
                m = re.compile(r"([A-Za-z]+):(?=\S)").match(text, i)
                if m:
                    name = m[1].lower()
                    known = _SPELLED.get(name)
                    v, form, j = self.value(m.end())
                    if known is None and (name in RETIRED or (name not in ("http", "https") and nearest(name, _SPELLED))):
                        meant = RETIRED.get(name) or _SPELLED[nearest(name, _SPELLED)].name
                        self.say("unknown_operator", i, m.end(), f"Unknown operator {m[1]}:", text[:i] + meant + ":" + text[m.end() :])
                        i = j
                        continue
                    if known is not None:
                        out.append(_Token("op", i, j, v, form, known.name))
                        i = j
                        continue
                v, _, j = self.value(i)
                j = max(j, i + 1)
                word = text[i:j]
                kind = {"AND": "and", "OR": "or", "NOT": "not"}.get(word, "word")
                if kind == "word" and "|" in word.strip("|"):
                    self.say("pipe_in_word", i, j, "| is searched as it stands; OR means either", text[:i] + "(" + " OR ".join(word.split("|")) + ")" + text[j:], warning=True)
                out.append(_Token(kind, i, j, word))
                i = j
        return out


class _Parser:
    def __init__(self, reader: _Reader):
        self.reader, self.tokens, self.at = reader, reader.tokens(), 0

    def peek(self) -> str | None:
        return self.tokens[self.at].kind if self.at < len(self.tokens) else None

    def join(self, kind: str, kids: list[Node]) -> Node | None:
        flat = [x for k in kids for x in (k.kids if k.kind == kind else [k])]
        return None if not flat else flat[0] if len(flat) == 1 else Node(kind, flat[0].start, flat[-1].end, flat)

    def either(self, depth: int = 0) -> Node | None:
        kids = [self.all(depth)]
        while self.peek() == "or":
            t = self.tokens[self.at]
            self.at += 1
            nxt = self.all(depth)
            if kids[-1] is None or nxt is None:
                self.reader.say("missing_operand", t.start, t.end, "OR needs something on both sides")
            kids.append(nxt)
        return self.join("or", [k for k in kids if k])

    def all(self, depth: int) -> Node | None:
        kids = []
        while self.peek() not in (None, "or", ")"):
            if self.peek() == "and":
                t = self.tokens[self.at]
                self.at += 1
                if not kids or self.peek() in (None, "or", "and", ")"):
                    self.reader.say("missing_operand", t.start, t.end, "AND needs something on both sides")
                continue
            kid = self.one(depth)
            if kid:
                kids.append(kid)
        return self.join("and", kids)

    def one(self, depth: int) -> Node | None:
        t = self.tokens[self.at]
        self.at += 1
        if t.kind == "not":
            if self.peek() in (None, "or", "and", ")"):
                self.reader.say("missing_operand", t.start, t.end, "NOT needs something after it")
                return None
            kid = self.one(depth)
            return Node("not", t.start, kid.end, [kid]) if kid else None
        if t.kind == "(":
            if depth >= MOST_DEPTH:
                self.reader.say("unmatched_paren", t.start, t.end, "Groups are nested too deeply")
                self.at = len(self.tokens)
                return None
            empty = self.peek() == ")"
            inner = self.either(depth + 1)
            if self.peek() == ")":
                end = self.tokens[self.at].end
                self.at += 1
                if empty:
                    self.reader.say("empty_group", t.start, end, "The group is empty", self.reader.text[: t.start] + self.reader.text[end:])
            else:
                self.reader.say("unclosed_paren", t.start, t.end, "The parenthesis is not closed", self.reader.text + ")")
            return inner
        if t.kind == "op":
            return Node("op", t.start, t.end, op=t.op, value=t.value, form=t.form)
        return Node("text", t.start, t.end, value=t.value, form="word" if t.kind == "word" else t.kind)


def parse(text: str) -> Query:
    """Reads a query; diagnostics say what is wrong with it, with a corrected text where there is one."""
    reader = _Reader(text)
    if units(text) > MOST_UNITS:
        reader.say("query_too_long", 0, len(text), f"Queries have at most {MOST_UNITS} characters")
        return Query(text, None, reader.found, {})
    parser = _Parser(reader)
    roots = [parser.either()]
    while parser.peek() == ")":
        t = parser.tokens[parser.at]
        reader.say("unmatched_paren", t.start, t.end, "No parenthesis is open here", text[: t.start] + text[t.end :])
        parser.at += 1
        roots.append(parser.either())
    root = parser.join("and", [r for r in roots if r])
    if root:
        for node in root.walk():
            if node.kind == "op":
                _check_value(reader, node)
            elif node.kind == "text" and node.form == "regex":
                _check_regex(reader, node)
    options: dict[str, str] = {}
    places: list[str] = []
    root = _globals(reader, root, options, places, True)
    query = Query(text, root, reader.found, options, tuple(places))
    if root:
        for node in root.walk():
            if (node.kind == "text" and node.value != "") or (node.kind == "op" and node.op in ("content", "ref", "struct", "message", "symbol")):
                node.term = len(query.terms)
                query.terms.append(node)
        _check_modes(reader, query)
    return query


def _check_regex(reader: _Reader, node: Node) -> None:
    try:
        regex(node.value)
    except BadPattern as e:
        reader.say("invalid_regex", node.start, node.end, f"Not a valid RE2 regex: {e}", reader.text[: node.start] + '"' + node.value + '"' + reader.text[node.end :] if node.kind == "text" else None)


def _check_value(reader: _Reader, node: Node) -> None:
    op, value = OPERATORS[node.op], node.value
    bad = lambda message, fix=None: reader.say("bad_value", node.start, node.end, message, fix)
    swap = lambda v: reader.text[: node.start] + f"{op.name}:{v}" + reader.text[node.end :]
    if op.reads == "path" and node.form != "phrase":
        try:
            regex(value)
            valid = True
        except BadPattern:
            valid = False
        node.form = "glob" if reads_as_glob(value, valid) else "regex"
        if node.form == "regex":
            _check_regex(reader, node)
    elif op.reads == "text" and node.form == "regex":
        _check_regex(reader, node)
    elif op.reads == "window" and not dates.is_window(value):
        bad(f"{op.name}: takes a length of time like 2w, a date like 2026-01-31, or today")
    elif op.reads == "one":
        node.value = value.lower()
        if node.value not in op.values:
            near = nearest(value, op.values)
            bad(f"{op.name}: takes {', '.join(op.values)}", swap(near) if near else None)
    elif op.reads == "language":
        known = LANGUAGE_NAMES.get(value.lower())
        if known is None and not re.fullmatch(r"[a-z]{2}", value):  # two letters: a corpus of its own vocabulary
            near = nearest(value, LANGUAGE_NAMES)
            bad(f"Unknown language {value}", swap(near) if near else None)
        node.value = known or value
    elif op.reads == "count":
        node.value = value.lower()
        if node.value != "all" and not (value.isdecimal() and 1 <= int(value) <= MOST_RESULTS):
            bad(f"count: takes 1 to {MOST_RESULTS} or all")
    elif op.reads == "reference" and (node.form == "regex" or not re.fullmatch(r"\S+", value)):
        bad("ref: takes one name")
    elif op.reads == "template" and node.form != "phrase":
        bad('struct: takes a quoted template like "f(:[x])"', swap('"' + value + '"'))


def _globals(reader: _Reader, node: Node | None, options: dict, places: list, top: bool) -> Node | None:
    """Takes the operators that hold for the whole query out of the tree."""
    if node is None:
        return None
    negated = node.kind == "not" and node.kids[0].kind == "op" and node.kids[0].op == "in"
    target = node.kids[0] if negated else node
    if target.kind == "op" and OPERATORS[target.op].whole:
        if not top or (node.kind == "not" and not negated):
            reader.say("global_misplaced", node.start, node.end, f"{target.op}: holds for the whole query; it can't be inside a group, OR or NOT")
        elif negated:
            places.append(target.value)
        elif target.op in options and options[target.op] != target.value:
            reader.say("duplicate_global", node.start, node.end, f"{target.op}: is given twice", reader.text[: node.start].rstrip() + reader.text[node.end :])
        else:
            options[target.op] = target.value
        return None
    if node.kind in ("and", "or", "not"):
        kids = [_globals(reader, k, options, places, top and node.kind == "and") for k in node.kids]
        kids = [k for k in kids if k]
        if node.kind == "not":
            return Node("not", node.start, node.end, kids) if kids else None
        return None if not kids else kids[0] if len(kids) == 1 else Node(node.kind, node.start, node.end, kids)
    return node


def _check_modes(reader: _Reader, query: Query) -> None:
    root, commits = query.root, query.commits
    for node in root.walk():
        if node.kind == "op":
            scope = OPERATORS[node.op].scope
            if commits and (scope == "files" or (node.op == "is" and node.value in ("open", "changed"))):
                reader.say("op_wrong_mode", node.start, node.end, f"{node.op}: works on current files, and this query searches commits")
            if "at" in query.options and (scope == "commits" or node.op in ("since", "until") or (node.op == "is" and node.value in ("open", "changed"))):
                reader.say("op_with_at", node.start, node.end, f"{node.op}: can't be used with at:")
        if node.kind == "or":
            history = [any(x.kind == "op" and OPERATORS[x.op].scope == "commits" for x in k.walk()) for k in node.kids]
            files = [any(x.kind == "op" and OPERATORS[x.op].scope == "files" for x in k.walk()) for k in node.kids]
            if any(history) and any(files):
                reader.say("mixed_mode_or", node.start, node.end, "One side of OR searches commits and the other current files")
        if node.kind in ("text", "op") and node.form == "regex" and commits and node.op in ("", "content") and ("\\n" in node.value or "\n" in node.value):
            reader.say("multiline_in_history", node.start, node.end, "Commits are matched line by line, so \\n never matches", warning=True)
    if "at" in query.options and query.options.get("type") in COMMIT_TYPES:
        reader.say("op_with_at", 0, len(reader.text), "type:commit can't be used with at:")
    positive = [n for n in _positive(root)]
    if not positive and not commits:
        reader.say("no_positive_term", root.start, root.end, "Name something to find: a query of only NOT matches nearly everything")
    if commits and not any(n.kind == "text" or n.op in ("author", "message", "content", "file", "since") for n in positive):
        reader.say("history_full_scan", root.start, root.end, "This reads every commit; a word, an author or since: narrows it", warning=True)


def _positive(node: Node):
    if node.kind in ("text", "op"):
        yield node
    elif node.kind != "not":
        for k in node.kids:
            yield from _positive(k)
