"""Search over current files: lines, file names, definitions, counts of what filters hide, facets, ranking, paging."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuscope.functions import languages
from corpuscope.functions.patterns import EXACT, FOLD, excludes_glob, folded, owners_glob, path_glob, regex, spans_lines, word_edges
from corpuscope.operators import structure
from corpuscope.plans.compiler import Settings, Terms, all_of, any_of, condition, conjuncts, contributing, filter_reason, text_lines, truth, yes
from corpuscope.plans.query import Node, Query, parse

# What a line's match adds on a page, and the most that a file's lines add.
WHOLE_WORD, AS_TYPED, MOST_QUALITY = 3, 1, 15
#: Columns a corpus may leave out, and what stands for them.
DEFAULTS = {
    "repo_ord": "0", "last_at": "CAST(NULL AS timestamp)", "dirty": "false", "open": "false", "last_author": "CAST(NULL AS string)",
    "symbols": "CAST(array() AS array<struct<name:string,kind:string,line:int,end:int>>)",
}


@dataclass
class Corpus:
    """``files``: repo, path, lang, content, and any of the columns in ``DEFAULTS``. ``owners``: rules in order, the last
    that matches wins. ``excludes``: patterns in order, the first that matches wins."""

    files: DataFrame
    owners: list[tuple[str, list[str]]] | None = None
    excludes: list[str] = field(default_factory=list)

    def table(self) -> DataFrame:
        missing = {c: F.expr(e) for c, e in DEFAULTS.items() if c not in self.files.columns}
        return self.files.withColumns(missing) if missing else self.files


def owners_of(path: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """The owners that the last matching rule names; no rule or a rule without owners: none."""
    out = F.array().cast("array<string>")
    for pattern, names in rules:  # later rules wrap earlier ones
        out = F.when(path.rlike(owners_glob(pattern)), F.array(*map(F.lit, names)).cast("array<string>")).otherwise(out)
    return out


def hiding_pattern(path: Column, patterns: list[str]) -> Column:
    """The first exclude pattern that matches, or null."""
    out = F.lit(None).cast("string")
    for pattern in reversed(patterns):
        out = F.when(path.rlike(excludes_glob(pattern)), F.lit(pattern)).otherwise(out)
    return out


class FileSearch:
    """One query over one corpus. Everything is lazy; counts are aggregates over one pass of the files."""

    def __init__(self, corpus: Corpus, query: Query | str, settings: Settings | None = None):
        self.corpus = corpus
        self.query = parse(query) if isinstance(query, str) else query
        if not self.query.ok:
            raise ValueError("; ".join(d.message for d in self.query.diagnostics if not d.warning))
        self.settings = settings or Settings()
        self.terms = Terms(self.query, self.settings)
        self.kids = conjuncts(self.query.root)

    # leaves

    def meta(self, node: Node) -> Column | None:
        """Leaves on a file's metadata; None for terms."""
        t, path = self.terms, F.col("path")
        if node.kind != "op" or node.op in ("content", "ref", "struct", "symbol"):
            return None
        if node.op == "file":
            return t.path_value(node, path)
        if node.op == "repo":
            return t.path_value(node, F.col("repo"))
        if node.op == "language":
            return F.col("lang") == node.value
        if node.op in ("since", "until"):
            late = F.col("dirty") | yes(F.col("last_at") >= F.lit(t.window(node)))
            return late if node.op == "since" else ~late
        if node.op == "kind":
            return F.exists("symbols", lambda s: s["kind"] == node.value)
        if node.op == "owner":
            if self.corpus.owners is None:
                return F.lit(False)
            owned = owners_of(path, self.corpus.owners)
            if node.form != "phrase" and node.value.lower() == "none":
                return F.size(owned) == 0
            want = node.value.lower().removeprefix("@")
            plain = lambda o: F.regexp_replace(F.lower(o), "^@", "")
            return F.exists(owned, lambda o: (plain(o) == want) | (plain(o).endswith("/" + want)))
        if node.op == "is":
            return {
                "open": lambda: F.col("open"), "changed": lambda: F.col("dirty"), "test": lambda: languages.is_test(path),
                "vendored": lambda: languages.is_vendored(path, self.settings.vendored and list(self.settings.vendored)),
                "generated": lambda: languages.is_generated(path, F.col("content"), self.settings.generated and list(self.settings.generated)),
            }[node.value]()
        raise NotImplementedError(node.op)

    def uses(self, node: Node) -> Column:
        """Lines with a whole-word use of a name, without those that define it."""
        defined = F.transform(F.filter("symbols", lambda s: s["name"] == node.value), lambda s: s["line"])
        lines = F.transform(text_lines(F.col("content")), lambda x, i: F.struct(x.alias("text"), (i + 1).alias("line")))
        return F.exists(lines, lambda x: self.terms.in_line(node, x["text"]) & ~F.array_contains(defined, x["line"]))

    def text_leaf(self, node: Node) -> Column:
        """Leaves for the code section: a term has a matching line."""
        meta = self.meta(node)
        if meta is not None:
            return meta
        if node.op == "symbol":
            return F.exists("symbols", lambda s: self.terms.in_path(node, s["name"]))
        if node.op == "ref":
            return F.contains(F.col("content"), F.lit(node.value)) & self.uses(node)
        if node.op == "struct":
            return F.size(structure.find_column(F.col("content"), F.col("lang"), node.value)) > 0
        if node.form == "regex" and spans_lines(node.value):
            return F.col("content").rlike("(?m)" + self.terms.java(node))
        return self.terms.in_text(node, F.col("content"))

    def name_leaf(self, node: Node, negated: bool) -> Column:
        """Leaves for the names section: a word matches the path; under NOT, and for content:, the text."""
        meta = self.meta(node)
        if meta is not None:
            return meta
        if node.kind == "op" or negated:
            return self.text_leaf(node) | (self.terms.in_path(node, F.col("path")) if negated and node.kind == "text" else F.lit(False))
        found = self.terms.in_path(node, F.col("path"))
        if self.query.options.get("match", self.settings.match) == "fuzzy" and node.form == "word":
            found = found | self.terms.fuzzy(node, F.col("path"))
        return found

    def _name_truth(self, node: Node, negated: bool = False) -> Column:
        if node.kind in ("and", "or"):
            parts = [self._name_truth(k, negated) for k in node.kids]
            return all_of(parts) if node.kind == "and" else any_of(parts)
        if node.kind == "not":
            return ~self._name_truth(node.kids[0], not negated)
        return yes(self.name_leaf(node, negated))

    # sections

    @cached_property
    def files(self) -> DataFrame:
        """The corpus with ``hiding``, the exclude pattern that hides a file."""
        return self.corpus.table().withColumn("hiding", hiding_pattern(F.col("path"), self.corpus.excludes))

    def visible(self, df: DataFrame) -> DataFrame:
        return df if self.query.options.get("excludes") == "no" or not self.corpus.excludes else df.where("hiding IS NULL")

    def _ordered(self, nodes: list[Node]) -> list[Node]:
        """Conjuncts with metadata first: they are cheap, and some reach the scan."""
        return sorted(nodes, key=lambda n: any(x.kind == "text" or (x.kind == "op" and self.meta(x) is None) for x in n.walk()))

    def matching(self, leave: Node | None = None) -> DataFrame:
        """Files that match as code, each conjunct a filter of its own, cheap ones first; ``leave`` names a conjunct that the caller tests."""
        df = self.visible(self.files)
        for kid in self._ordered(self.kids):
            if kid is not leave:
                df = df.where(condition(kid, self.text_leaf))
        return df

    def incomplete(self) -> DataFrame:
        """``repo``, ``path``: files in which the search for a template ran out of steps, so matches may be missing and a NOT proves
        nothing."""
        found = [structure.searched_column(F.col("content"), F.col("lang"), n.value)["complete"] for n in (self.query.root.walk() if self.query.root else ()) if n.op == "struct"]
        return self.visible(self.files).where(~all_of(found)).select("repo", "path")

    def _is_term(self, node: Node) -> bool:
        return node.term >= 0 and node.op != "symbol"

    def _line_terms(self) -> list[Node]:
        under_not = {id(x) for n in (self.query.root.walk() if self.query.root else ()) if n.kind == "not" for x in n.walk()}
        return [n for n in self.query.terms if self._is_term(n) and id(n) not in under_not]

    def _line_hit(self, node: Node, line: Column, number: Column) -> Column:
        hit = self.terms.in_line(node, line)
        if node.op == "ref":
            hit = hit & ~F.exists("symbols", lambda s: (s["name"] == node.value) & (s["line"] == number))
        return hit

    def facts(self, named: bool = False) -> dict[str, Column]:
        """What results carry of their file: which one it is, and what ranks it. They can't look it up by its path, which several files of a table
        may have. ``named``: results without lines, which need no text read."""
        text = F.lit(None).cast("long") if named else F.xxhash64("content")
        return {"file": F.struct("repo", "path", text.alias("text")), "last_at": F.col("last_at"), "score": self.score()}

    def lines(self) -> DataFrame:
        """Code lines: ``repo``, ``path``, ``lang``, ``line`` (from 1), ``text``: those with a match of a term that made the file
        match."""
        return self._lines_of(self._line_terms(), {})

    def _lines_of(self, terms: list[Node], facts: dict[str, Column]) -> DataFrame:
        carried = [c.alias(name) for name, c in facts.items()]
        templates = [n for n in terms if n.op == "struct"]
        if templates:
            parts = [structure.structure_lines(self, n, facts).withColumn("_k", F.lit(k)) for k, n in enumerate(templates)]
            rest = [n for n in terms if n.op != "struct"]
            if rest:
                parts.append(self._lines_of(rest, facts).select("repo", "repo_ord", "path", "lang", *facts, "line", "text").withColumn("_k", F.lit(len(parts))))
            # a line that several terms match comes once, as the first of them shows it
            return parts[0].drop("_k") if len(parts) == 1 else reduce(DataFrame.unionByName, parts).groupBy("repo", "repo_ord", "path", "lang", *facts, "line").agg(F.min_by("text", "_k").alias("text"))
        if "in" in self.query.options or self.query.left_out_places:
            return self._placed_lines(terms, facts)
        if any(n.form == "regex" and regex(n.value).newline and spans_lines(n.value) for n in terms):
            return structure.multiline_lines(self, terms, facts)
        contrib = contributing(self.query.root, self.text_leaf, self._is_term)
        # A conjunction's terms all contribute wherever the file matches; flags are needed only where OR leaves a choice.
        choice = self.query.root is not None and any(n.kind == "or" for n in self.query.root.walk())
        keep = [c for c in ("repo", "repo_ord", "path", "lang") if c in self.files.columns]
        flags = [contrib[n.term].alias(f"_c{n.term}") for n in terms] if choice else []
        uses = [F.col("symbols")] if any(n.op == "ref" for n in terms) else []
        df = self.matching().select(*keep, *carried, *flags, *uses, F.posexplode(text_lines(F.col("content"))).alias("line", "text"))
        df = df.withColumn("line", F.col("line") + 1)
        hits = [(F.col(f"_c{n.term}") if choice else F.lit(True)) & self._line_hit(n, F.col("text"), F.col("line")) for n in terms]
        return df.where(any_of(hits)).select(*keep, *facts, "line", "text")

    def _placed_lines(self, terms: list[Node], facts: dict[str, Column]) -> DataFrame:
        """Lines with a match in the wanted places: comments, strings or code."""
        wanted = (self.query.options["in"],) if "in" in self.query.options else ()
        spans = [structure.matches_in(F.col("content"), F.col("lang"), self.terms.java(n), wanted, self.query.left_out_places) for n in terms]
        carried = [c.alias(name) for name, c in facts.items()]
        df = self.matching().select("repo", "repo_ord", "path", "lang", *carried, "content", F.concat(*spans).alias("spans")).where(F.size("spans") > 0)
        before = lambda s: F.length(F.regexp_replace(F.substring(F.col("content"), F.lit(1), s["start"]), "[^\n]", "")) + 1
        df = df.select("repo", "repo_ord", "path", "lang", *facts, text_lines(F.col("content")).alias("all"), F.explode(F.array_distinct(F.transform("spans", before))).alias("line"))
        return df.select("repo", "repo_ord", "path", "lang", *facts, "line", F.element_at("all", F.col("line")).alias("text"))

    def names(self) -> DataFrame:
        """File names: files whose path matches the query's words."""
        return self._names({})

    def _names(self, facts: dict[str, Column]) -> DataFrame:
        df = self.visible(self.files)
        for kid in self._ordered(self.kids):
            df = df.where(self._name_truth(kid))
        return df.select("repo", "repo_ord", "path", "lang", *[c.alias(name) for name, c in facts.items()])

    def definitions(self) -> DataFrame:
        """Definitions: of files that match, those whose name and kind the query names; words must stand in their lines."""
        return self._definitions({})

    def _definitions(self, facts: dict[str, Column]) -> DataFrame:
        is_word = lambda n: n.kind == "text" or n.op == "content"
        df = self.visible(self.files)
        for kid in self._ordered([n for n in self.kids if not any(is_word(x) for x in n.walk())]):
            df = df.where(condition(kid, self.text_leaf))  # files with such definitions
        body = F.slice(text_lines(F.col("content")), F.col("s.line"), F.col("s.end") - F.col("s.line") + 1)

        def leaf(n: Node, negated: bool) -> Column:
            if n.op == "symbol" and not negated:
                return self.terms.in_path(n, F.col("s.name"))
            if n.op == "kind" and not negated:
                return F.col("s.kind") == n.value
            return F.exists(body, lambda x: self.terms.in_line(n, x)) if is_word(n) and not negated else self.text_leaf(n)

        def holds(n: Node, negated: bool = False) -> Column:
            if n.kind in ("and", "or"):
                return (all_of if n.kind == "and" else any_of)([holds(k, negated) for k in n.kids])
            return ~holds(n.kids[0], not negated) if n.kind == "not" else yes(leaf(n, negated))

        df = df.select("*", F.explode("symbols").alias("s"))
        for kid in self.kids:
            df = df.where(holds(kid))
        return df.select("repo", "repo_ord", "path", "lang", *[c.alias(name) for name, c in facts.items()], "s.name", "s.kind", "s.line", "s.end")

    def wants_definitions(self) -> bool:
        """Whether the query names definitions, anywhere but under NOT."""
        def named(n: Node) -> bool:
            return n.op in ("symbol", "kind") or (n.kind in ("and", "or") and any(map(named, n.kids)))

        return self.query.root is not None and named(self.query.root)

    def results(self) -> DataFrame:
        """All sections in one table: definitions, then names, then code, by the query's kind of result."""
        return self._sections(False)

    def _sections(self, ranked: bool) -> DataFrame:
        kind = self.query.options.get("type")
        facts, named = (self.facts(), self.facts(named=True)) if ranked else ({}, {})
        wide = ["section", "repo", "repo_ord", "path", "lang", *facts, "line", "text"]
        has_text = bool(self._line_terms())
        parts = []
        placed = "in" in self.query.options or self.query.left_out_places
        if self.wants_definitions():
            defined = self._definitions(facts).where(F.lit("code" not in self.query.left_out_places))
            parts.append(defined.select(F.lit(0).alias("section"), "repo", "repo_ord", "path", "lang", *facts, "line", F.col("name").alias("text")))
        else:
            if kind == "file" or (kind is None and not placed):
                parts.append(self._names(named).select(F.lit(1).alias("section"), "repo", "repo_ord", "path", "lang", *named, F.lit(None).cast("int").alias("line"), F.lit(None).cast("string").alias("text")))
            if kind in (None, "code") and has_text:
                parts.append(self._lines_of(self._line_terms(), facts).select(F.lit(2).alias("section"), "repo", "repo_ord", "path", "lang", *facts, "line", "text"))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.select(*wide)

    # order and pages

    def ordered(self) -> DataFrame:
        """order:file, order:recent or by rank; always ends in a total order. Besides the results' columns ``file``, which ``shown`` reads, ``last_at`` and
        ``score``."""
        df = self._sections(True)
        order = self.query.options.get("order", self.settings.order)
        tail = ["repo_ord", "path", "line"]
        if order.startswith("file"):
            return df.orderBy("section", "repo_ord", F.desc("path") if order.endswith("desc") else F.asc("path"), "line")
        if order.startswith("recent"):
            at = F.asc_nulls_last("last_at") if order.endswith("asc") else F.desc_nulls_last("last_at")
            return df.orderBy("section", at, F.desc("score"), *tail)
        return df.orderBy("section", F.desc("score"), *tail)

    def page(self, offset: int = 0) -> DataFrame:
        """The results from ``offset`` on: as many as the query or the settings ask for, with ``count:all`` every one."""
        count, rest = self.query.options.get("count"), self.ordered().offset(offset)
        return rest if count == "all" else rest.limit(int(count) if count else self.settings.count)

    def quality(self) -> Column:
        """How well a line's match fits: as a whole word, and in the case it was typed in."""
        words = [n for n in self._line_terms() if n.form != "regex" and n.op != "struct"]
        whole = any_of([F.col("text").rlike(FOLD + word_edges(n.value, folded)) for n in words])
        as_typed = any_of([F.contains(F.col("text"), F.lit(n.value)) for n in words])
        return F.when(yes(whole), WHOLE_WORD).otherwise(0) + F.when(yes(as_typed), AS_TYPED).otherwise(0)

    def regrouped(self, page: DataFrame) -> DataFrame:
        """A page by rank with each file's lines together, and files of a section by score and how well their lines on this page fit."""
        sums = F.least(F.sum(self.quality()).over(Window.partitionBy("section", "file")), F.lit(MOST_QUALITY))
        page = page.withColumn("_fit", F.col("score") + sums)
        return page.orderBy("section", F.desc("_fit"), "repo_ord", "path", "line").drop("last_at", "score", "_fit")

    def shown(self, page: DataFrame, around: int | None = None) -> DataFrame:
        """A page of lines with ``hits`` (UTF-16 start and end of every match, with its term), the text ``clipped`` around the first, and the lines ``before`` and ``after``.
        Only the page's files are read again."""
        around = self.settings.context if around is None else around
        content = self.files.select(self.facts()["file"].alias("file"), "content").groupBy("file").agg(F.first("content").alias("content")).select("file", text_lines(F.col("content")).alias("_all"))
        page = page.join(content, "file", "left")
        near = lambda a, n: F.when(F.col("line").isNotNull() & (n > 0), F.slice("_all", a, n)).otherwise(F.array().cast("array<string>"))
        first = F.greatest(F.col("line") - around, F.lit(1))
        page = page.withColumn("before", near(first, F.col("line") - first)).withColumn("after", near(F.col("line") + 1, F.lit(around)))
        marks = structure.highlight_column(F.col("text"), [(n.term, self.terms.java(n)) for n in self._line_terms() if n.op != "struct"])
        return page.drop("_all").withColumn("_m", marks).withColumn("hits", F.col("_m.hits")).withColumn("clipped", F.col("_m.clipped")).drop("_m")

    def symbols_as_text(self) -> int | None:
        """How many results the query would have with its symbol: values as plain words; None if it has none."""
        names = [n for n in self.query.root.walk() if n.op == "symbol"] if self.query.root else []
        if not names:
            return None
        text = self.query.text
        for n in sorted(names, key=lambda n: -n.start):
            text = text[: n.start] + (f"/{n.value}/" if n.form == "regex" else f'"{n.value}"' if n.form == "phrase" else n.value) + text[n.end :]
        return FileSearch(self.corpus, text, self.settings).results().count()

    def score(self) -> Column:
        """A file's rank: it defines a searched name, its name has a word, it is open or lately changed; tests,
        vendored, generated and hidden files go down, by the gravest of these only."""
        path, words = F.col("path"), [n for n in self._line_terms() if n.form != "regex"]
        base = languages.base_name(path)
        stem = F.regexp_replace(base, r"\.[^.]*$", "")
        named = F.lit(0)
        for n in words:
            is_same = F.lower(stem) == n.value.lower()
            starts = stem.rlike(FOLD + "^" + folded(n.value))
            named = F.greatest(named, F.when(is_same, 40).when(starts, 20).when(base.rlike(FOLD + folded(n.value)), 5).otherwise(0))
        defines = any_of([F.array_contains("symbols.name", n.value) for n in words])
        fresh = F.col("last_at") >= F.lit(self.settings.now) - F.expr("INTERVAL 14 DAYS")
        down = F.when(F.col("hiding").isNotNull(), -3000).when(languages.is_generated(path), -2000).when(languages.is_vendored(path), -2000).when(languages.is_test(path), -1000).otherwise(0)
        return F.when(yes(defines), 100).otherwise(0) + named + F.when(F.col("open"), 30).otherwise(0) + F.when(F.col("dirty"), 15).when(yes(fresh), 10).otherwise(0) + down

    # counts

    def total(self) -> DataFrame:
        """``total``: all results are counted, so ``truncated`` is false."""
        return self.results().agg(F.count("*").alias("total")).withColumn("truncated", F.lit(False))

    def hidden(self) -> DataFrame:
        """``reason``, ``filter``, ``hidden``: for each filter how many lines it alone hides. In one pass over the files: a
        file counts where exactly one conjunct fails and that is the filter."""
        filters = [(k, n, filter_reason(n)) for k, n in enumerate(self.kids) if filter_reason(n)]
        if not filters:
            return self.corpus.files.sparkSession.createDataFrame([], "reason string, filter string, hidden long")
        terms = self._line_terms()
        sized = self.visible(self.files).select(*[truth(n, self.text_leaf).alias(f"_k{k}") for k, n in enumerate(self.kids)], *[F.col(c) for c in ("content", "symbols", "path")])
        fails = sum((~F.col(f"_k{k}")).cast("int") for k in range(len(self.kids)))
        sized = sized.withColumn("_fails", fails).where("_fails = 1")
        lines = F.transform(text_lines(F.col("content")), lambda x, i: F.struct(x.alias("t"), (i + 1).alias("i")))
        sized = sized.withColumn("_n", F.size(F.filter(lines, lambda x: any_of([self._line_hit(n, x["t"], x["i"]) for n in terms]))))
        sums = sized.agg(*[F.coalesce(F.sum(F.when(~F.col(f"_k{k}"), F.col("_n"))), F.lit(0)).cast("long").alias(f"_h{k}") for k, _, _ in filters])
        return sums.select(F.explode(F.array(*[F.struct(F.lit(r).alias("reason"), F.lit(self.query.text[n.start : n.end]).alias("filter"), F.col(f"_h{k}").alias("hidden")) for k, n, r in filters])).alias("x")).select("x.*")

    def hidden_by_type(self) -> DataFrame:
        """``hidden``: the code lines that a ``type:file`` query leaves out."""
        return self.relaxed(type="code").lines().agg(F.count("*").alias("hidden"))

    def shown_excluded(self) -> DataFrame:
        """With ``excludes:no``: ``shown``, how many results the editor's excludes would hide, and ``patterns``, those that would."""
        found = self.results().join(self.files.where("hiding IS NOT NULL").select("repo", "path", "hiding"), ["repo", "path"])
        return found.agg(F.count("*").alias("shown"), F.sort_array(F.collect_set("hiding")).alias("patterns"))

    def name_marks(self, page: DataFrame) -> DataFrame:
        """A page of names with ``hits``: UTF-16 spans of the words in the path, or, where a query has none, what its first ``file:`` matched, without
        a slash before it."""
        terms = [(n.term, self.terms.java(n)) for n in self._line_terms()]
        if terms:
            return page.withColumn("hits", structure.highlight_column(F.col("path"), terms)["hits"])
        named = [n for n in self.kids if n.op == "file" and n.form != "phrase"]
        if not named:
            return page.withColumn("hits", F.array().cast("array<struct<start:int,end:int,term:int>>"))
        body = path_glob(named[0].value) if named[0].form == "glob" else regex(named[0].value).java
        marks = structure.highlight_column(F.col("path"), [(-1, (EXACT if self.terms.exact else FOLD) + body)])["hits"]
        lead = lambda h: F.when(F.substring(F.col("path"), h["start"] + 1, F.lit(1)) == "/", 1).otherwise(0)
        return page.withColumn("hits", F.transform(F.slice(marks, 1, 1), lambda h: F.struct((h["start"] + lead(h)).alias("start"), h["end"].alias("end"), h["term"].alias("term"))))

    def relaxed(self, **options: str) -> FileSearch:
        """The same query with other options, say case="no"; what an option hides is the difference of the totals."""
        query = parse(self.query.text)
        query.options.update(options)
        return FileSearch(self.corpus, query, self.settings)

    def facets(self, most: int = 8) -> DataFrame:
        """``field``, ``label``, ``n``, ``more``: results by repo, language, folder and owner, the biggest ``most`` of each, and how
        many labels are left out."""
        found = self.results().select("repo", "lang", "path")
        fields = [("repo", F.col("repo")), ("lang", F.coalesce("lang", F.lit(""))), ("folder", F.when(F.contains(F.col("path"), F.lit("/")), F.substring_index("path", "/", 1)).otherwise(F.lit("")))]
        pairs = F.array(*[F.struct(F.lit(f).alias("field"), c.alias("label")) for f, c in fields])
        if self.corpus.owners is not None:
            owned = owners_of(F.col("path"), self.corpus.owners)
            owned = F.when(F.size(owned) == 0, F.array(F.lit("none"))).otherwise(owned)
            pairs = F.concat(pairs, F.transform(owned, lambda o: F.struct(F.lit("owner").alias("field"), o.alias("label"))))
        return top_labels(found.select(F.explode(pairs).alias("x")).select("x.*"), most)


def top_labels(pairs: DataFrame, most: int, newest_first: str = "") -> DataFrame:
    """(``field``, ``label``) counted; the biggest ``most`` labels of each field, ties by label, ``newest_first`` by label down."""
    counts = pairs.groupBy("field", "label").agg(F.count("*").alias("n"))
    first = F.when(F.col("field") == newest_first, F.lit(0)).otherwise(-F.col("n"))
    label = F.when(F.col("field") == newest_first, F.col("label"))
    place = F.row_number().over(Window.partitionBy("field").orderBy(first, F.desc_nulls_last(label), "label"))
    left = F.greatest(F.count("*").over(Window.partitionBy("field")) - most, F.lit(0))
    return counts.withColumn("place", place).withColumn("more", left).where(F.col("place") <= most).select("field", "label", "n", "more")
