"""The engine on small corpora, laws that hold on any, and the registered queries against DuckDB."""

import re
from datetime import datetime

import duckdb
import pytest

from corpuscope import api, queries
from corpuscope.operators import joins, lookup, replace, structure
from corpuscope.operators.files import Corpus, FileSearch, owners_of
from corpuscope.operators.history import CommitSearch, History, files_at, names_over_time
from corpuscope.plans.compiler import Settings, text_lines
from corpuscope.plans.query import MOST_RESULTS
from corpuscope.streaming.watch import apply_changes, start_watch, swept

DATA = "/root/testdata/sf0.001"
NOW = datetime(2026, 10, 3, 10)

FILES = [
    ("app", "src/retry.ts", "typescript", "// retry helper\nexport function retry(n) {\n  return call(n, 'retry later');\n}\n", "2026-10-01"),
    ("app", "src/client.py", "python", "import retry\nclass Client:\n    def get(self):\n        return backoff(call(a, b), tries=3)\n", "2026-01-01"),
    ("app", "src/retry_test.py", "python", "def test_retry():\n    # backoff(x, tries=1)\n    assert Retry\n", None),
    ("app", "vendor/lib/retry.js", "javascript", "var retry = 1", None),
    ("lib", "README.md", "markdown", "Retry\r\nKelvin \u212a\r\nlast line with caf\u00e9", "2026-09-30"),
    ("lib", "empty.txt", "text", None, None),
]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(r, 0 if r == "app" else 1, p, x, c, d and datetime.fromisoformat(d)) for r, p, x, c, d in FILES]
    files = spark.createDataFrame(rows, "repo string, repo_ord int, path string, lang string, content string, last_at timestamp")
    files = files.withColumn("symbols", structure.symbols_column(files.content, files.lang)).cache()
    return Corpus(files, owners=[("*", ["@all"]), ("src/", ["@core/team"]), ("README.md", [])], excludes=["vendor/**"])


def lines(corpus, text, settings=None):
    return sorted((r.path, r.line) for r in FileSearch(corpus, text, settings or Settings(now=NOW)).lines().collect())


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("retry -f:src", [("README.md", 1)]),
        ("case:yes Retry", [("README.md", 1), ("src/retry_test.py", 3)]),
        ("Retry type:code", [("README.md", 1), ("src/retry_test.py", 3)]),
        ("kelvin k", [("README.md", 1), ("README.md", 2)][1:]),
        (r"/^var/ excludes:no", [("vendor/lib/retry.js", 1)]),
        (r"/\bcaf/", [("README.md", 3)]),
        ("/retry$/", [("README.md", 1), ("src/client.py", 1), ("src/retry_test.py", 3)]),
        ("word:yes call", [("src/client.py", 4), ("src/retry.ts", 3)]),
        ("import OR helper", [("src/client.py", 1), ("src/retry.ts", 1)]),
        ("retry since:2w", [("README.md", 1), ("src/retry.ts", 1), ("src/retry.ts", 2), ("src/retry.ts", 3)]),
        ("retry until:2026-02 is:test OR import until:2026-02", [("src/client.py", 1), ("src/retry_test.py", 1), ("src/retry_test.py", 3)]),
        ("retry owner:none", [("README.md", 1)]),
        ("import owner:team", [("src/client.py", 1)]),
        ("ref:retry", [("src/client.py", 1), ("src/retry.ts", 1), ("src/retry.ts", 3)]),
        ('struct:"backoff(:[c], tries=:[n])"', [("src/client.py", 4)]),
    ],
)
def test_lines(corpus, text, want):
    assert lines(corpus, text) == want


def test_names_and_sections(corpus):
    assert sorted(r.path for r in FileSearch(corpus, "retry type:file").names().collect()) == ["src/retry.ts", "src/retry_test.py"]
    assert sorted(r.path for r in FileSearch(corpus, "match:fuzzy type:file rt excludes:no").names().collect()) == ["src/retry.ts", "src/retry_test.py", "vendor/lib/retry.js"]
    got = FileSearch(corpus, "retry order:file").ordered().collect()
    assert [(r.section, r.path) for r in got] == sorted([(r.section, r.path) for r in got], key=lambda x: (x[0], x[1] == "README.md", x[1]))
    best = FileSearch(corpus, "retry excludes:no type:file", Settings(now=NOW)).page().collect()
    assert [r.path for r in best] == ["src/retry.ts", "src/retry_test.py", "vendor/lib/retry.js"]
    assert FileSearch(corpus, "retry count:2").page().count() == 2


def test_definitions(corpus):
    got = FileSearch(corpus, "sym:/^(get|Client|retry)$/").definitions().collect()
    assert sorted((r.name, r.kind, r.line, r.end) for r in got) == [("Client", "class", 2, 4), ("get", "method", 3, 4), ("retry", "function", 2, 4)]
    assert [r.name for r in FileSearch(corpus, "kind:method").definitions().collect()] == ["get"]
    assert [r.name for r in FileSearch(corpus, "kind:method backoff").definitions().collect()] == ["get"]
    assert [r.name for r in lookup.find_symbols(corpus.table(), "ret").collect()] == ["retry", "test_retry"]
    assert [(r.line, r.text) for r in lookup.preview(corpus.table(), "app", "src/client.py", 2, 1).collect()] == [(1, "import retry"), (2, "class Client:"), (3, "    def get(self):")]


def test_hidden_is_the_difference(corpus):
    for text in ("retry -f:client -is:test", "retry since:2w -helper", "retry owner:all -later"):
        search = FileSearch(corpus, text + " type:code", Settings(now=NOW))
        for row in search.hidden().collect():
            without = FileSearch(corpus, (text + " type:code").replace(row["filter"], ""), Settings(now=NOW)).lines()
            assert row.hidden == without.count() - search.lines().count(), (text, row)


def test_laws(corpus):
    pick = lambda t: set(lines(corpus, t + " type:code"))
    assert pick("(retry OR import)") == pick("retry") | pick("import")
    assert pick("case:no Retry") >= pick("case:yes Retry")
    assert pick("retry since:1y") >= pick("retry since:6m")
    assert {p for p, _ in pick("retry -import")} == {p for p, _ in pick("retry")} - {p for p, _ in pick("import")}


def test_text_lines(spark):
    df = spark.createDataFrame([("a\nb",), ("a\n",), ("a\r\n\r\nb\r",), ("",), (None,), ("\n\n",)], "c string")
    assert [r[0] for r in df.select(text_lines(df.c)).collect()] == [["a", "b"], ["a"], ["a", "", "b"], [""], None, ["", ""]]


def test_owners(spark):
    df = spark.createDataFrame([("src/a",), ("x/README.md",)], "path string")
    assert [r[0] for r in df.select(owners_of(df.path, [("*", ["a"]), ("README.md", [])])).collect()] == [["a"], []]


def test_replace(corpus):
    plan = replace.plan(FileSearch(corpus, "/re(try|ad)/ case:yes type:code f:retry.ts"), "${1}:$0$$").collect()
    assert [(r.path, r.n) for r in plan] == [("src/retry.ts", 3)]
    assert [(e.start, e.end, e.new_text) for e in plan[0].lines[0].edits] == [(3, 8, "try:retry$")]
    with pytest.raises(ValueError, match="exactly one"):
        replace.plan(FileSearch(corpus, "a b"), "x")
    with pytest.raises(ValueError, match="group"):
        replace.expand("$7", re.compile("(a)").match("a"))


def test_places():
    text = 'x = "a # b" # c\ny = 1'
    assert structure.places(text, "python") == [("strings", 4, 11), ("comments", 12, 15)]
    assert structure.place_of(structure.places(text, "python"), 5, 6) == "strings" and structure.place_of([("comments", 0, 4)], 2, 6) == "across"


def test_headings_of_pages():
    long = "long " * 40 + "tail"
    got = structure.definitions(f"<h1>a</h1><h2 class=x>{long}</h2>\n<H3>c</H3>", "html")
    assert [(d["name"], d["line"]) for d in got] == [("a", 1), (long, 1), ("c", 2)]


def test_structures():
    code = "f(a, g(b, c)); f(x, x); // f(p, q)\nf(s, 'f(1, 2)')"
    find = lambda t: [code[a:b] for a, b in structure.find_structures(code, "javascript", t)[0]]
    assert find("f(:[a], :[b])") == ["f(a, g(b, c))", "f(x, x)", "f(s, 'f(1, 2)')"]
    assert find("f(:[a], :[a])") == ["f(x, x)"]
    assert structure.find_structures("((((" * 50, "javascript", "(:[a](:[b](:[c])", budget=100)[1] is False


def test_multiline():
    spans = structure.multiline_spans("a\r\nb\nc\na\nb", re.compile("a\nb"))
    assert [(x[2], x[3]) for x in spans] == [(1, 2), (4, 5)]


def test_fuzzy_score():
    assert structure.fuzzy_score("retry_policy.py", "rp") > structure.fuzzy_score("retrap", "rp") > 0 and structure.fuzzy_score("abc", "z") is None


def test_outline():
    assert [(d["name"], d["depth"]) for d in structure.outline("class A:\n  def f(self):\n    pass\ndef g():\n  pass", "python")] == [("A", 0), ("f", 1), ("g", 0)]


@pytest.fixture(scope="module")
def history(spark):
    commits = spark.createDataFrame(
        [("app", 0, 2, "c1", "Jane Doe", "jane@x.org", datetime(2026, 9, 1), "Fix flaky test", ""), ("app", 0, 1, "c2", "Bob", "bob@x.org", datetime(2026, 10, 1), "Add timeout", "body retry"), ("lib", 1, 1, "d1", "Jane Doe", "JANE@x.org", datetime(2026, 10, 1), "Empty", "")],
        "repo string, repo_ord int, store_ord long, sha string, author_name string, author_email string, landed timestamp, subject string, body string",
    )
    line = "array<struct<sign:string,text:string>>"
    changes = spark.createDataFrame(
        [("app", "c1", "a/new.py", "a/old.py", None, [("+", "retry now"), ("-", "old retry")]), ("app", "c1", "b_test.py", None, None, [("+", "x")]), ("app", "c2", "c.go", None, None, [("-", "timeout = 1")])],
        f"repo string, sha string, path string, old_path string, now_path string, lines {line}",
    )
    return History(commits, changes)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("type:commit retry", ["c2", "c1"]), ("type:added retry", ["c1"]), ("type:removed timeout", ["c2"]), ("author:jane", ["d1", "c1"]), ('author:"bob"', ["c2"]),
        ("msg:/^Fix/ since:6w", ["c1"]), ("type:commit f:old retry", ["c1"]), ("author:jane -f:new", ["d1", "c1"]), ("type:commit since:1w x OR type:commit", []), ("type:commit timeout until:2026-09", []),
        ("type:commit (timeout OR empty)", ["c2", "d1"]), ("type:commit content:retry", ["c1"]), ("type:commit is:test x", ["c1"]), ("type:commit lang:go timeout", ["c2"]),
    ],
)
def test_commits(history, text, want):
    if " OR type:" in text:
        with pytest.raises(ValueError, match="whole query"):
            CommitSearch(history, text)
        return
    assert [r.sha for r in CommitSearch(history, text, Settings(now=NOW)).ordered().collect()] == want


def test_commit_details(history):
    row = CommitSearch(history, "type:commit retry", Settings(now=NOW)).commits().where("sha = 'c1'").first()
    assert (row.n_files, row.files, row.n_lines) == (1, ["a/new.py"], 2)
    assert [tuple(r) for r in CommitSearch(history, "type:commit retry since:1w", Settings(now=NOW)).hidden().collect()] == [("since:1w", 1)]
    months = [r.label for r in CommitSearch(history, "author:o", Settings(now=NOW)).facets().where("field = 'month'").collect()]
    assert sorted(months) == ["2026-09", "2026-10"]


def test_renames_and_revisions(spark):
    renames = spark.createDataFrame([("r", 1, "a", "b"), ("r", 2, "b", "c"), ("r", 3, "c", "d"), ("r", 1, "x", "y")], "repo string, ord int, old_path string, new_path string")
    assert {r.path: r.now_path for r in names_over_time(renames).collect()} == {"a": "d", "b": "d", "c": "d", "x": "y"}
    # a later file of an old name goes its own way, and chains have any length
    again = spark.createDataFrame([("r", 1, "x", "y"), ("r", 2, "z", "x"), *(("s", k, f"n{k}", f"n{k + 1}") for k in range(90))], "repo string, ord int, old_path string, new_path string")
    got = {(r.repo, r.path): r.now_path for r in names_over_time(again).collect()}
    assert got["r", "x"] == "y" and got["r", "z"] == "x" and {got["s", f"n{k}"] for k in range(90)} == {"n90"}
    assert names_over_time(again.limit(0)).count() == 0
    tree = spark.createDataFrame([("r", "same", "1"), ("r", "gone", "2"), ("r", "edit", "3"), ("r", "x", "4")], "repo string, path string, content string")
    now = spark.createDataFrame([("r", "same", "1"), ("r", "edit", "9"), ("r", "y", "4")], "repo string, path string, content string")
    assert {r.path: r.since_revision for r in files_at(tree, now, renames).collect()} == {"same": None, "gone": "deleted", "edit": "changed", "x": "renamed"}


def test_merges(spark):
    parents = [("m2", "m1", 1), ("m2", "f2", 2), ("f2", "f1", 1), ("f1", "m1", 1), ("m3", "m2", 1), ("m3", "f1", 2)]
    p = spark.createDataFrame([("r", *x) for x in parents], "repo string, sha string, parent string, nth int")
    t = spark.createDataFrame([("r", s, k) for k, s in enumerate(["m1", "m2", "m3"])], "repo string, sha string, ord int")
    assert {r.sha: r.merged_in for r in joins.merge_owner(p, t, spark).collect()} == {"f2": "m2", "f1": "m2"}


def test_shifted_line(spark):
    df = spark.createDataFrame([([(3, 2, 1), (10, 0, 4)], k) for k in (1, 3, 4, 5, 12)], "h array<struct<new_start:int,new_count:int,old_count:int>>, line int")
    assert [r[0] for r in df.select(lookup.shifted_line(df.h, df.line)).collect()] == [1, None, None, 4, 15]


def test_overlay_equals_rebuild(spark):
    base = spark.createDataFrame([(f"p{k}", f"old{k}") for k in range(10)], "path string, content string")
    changes = spark.createDataFrame([("p1", "n1", 1, False), ("p1", "n2", 2, False), ("p2", "", 3, True), ("p99", "new", 1, False), ("p3", "x", 1, False), ("p3", "", 2, True)], "path string, content string, ord int, deleted boolean")
    got = dict(tuple(r) for r in apply_changes(base, changes, ["path"], "ord").collect())
    assert got == {f"p{k}": f"old{k}" for k in range(10) if k not in (1, 2, 3)} | {"p1": "n2", "p99": "new"}


def test_sweep(spark):
    a = spark.createDataFrame([("same", 1), ("newer", 2), ("new", 1)], "path string, mod_time int")
    b = spark.createDataFrame([("same", 1), ("newer", 1), ("gone", 1)], "path string, mod_time int")
    assert {r.path: r.deleted for r in swept(a, b, ["path"]).collect()} == {"newer": False, "new": False, "gone": True}


def test_watch_stream_equals_batch(spark, history, tmp_path):
    history.commits.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(history.commits.schema).parquet(f"{tmp_path}/in")
    watch = {"jane": "author:jane", "retry": "type:commit retry"}
    start_watch(stream, lambda df: history.changes, watch, Settings(now=NOW), f"{tmp_path}/out", f"{tmp_path}/checkpoint", own_email="bob@x.org").awaitTermination(120)
    got = {(r.query, r.sha) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {("jane", "c1"), ("jane", "d1"), ("retry", "c1")}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in names)) for r in df.collect())
    result = con.execute(queries.SQL[name])
    order = [[d[0] for d in result.description].index(c) for c in names]
    assert got == sorted(repr(tuple(r[k] for k in order)) for r in result.fetchall())


def test_filters_reach_the_scan(spark):
    plan = queries.QUERIES["lang_filter"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,de)" in plan


def test_page_details(corpus):
    search = FileSearch(corpus, "retry type:code", Settings(now=NOW))
    page = search.page()
    got = [(r.path, r.line) for r in search.regrouped(page).collect()]
    assert got[:3] == [("src/retry.ts", 1), ("src/retry.ts", 2), ("src/retry.ts", 3)] and got[-1][0] == "src/retry_test.py" and len(got) == 7
    row = search.shown(page, around=1).where("path = 'src/retry.ts' AND line = 3").first()
    assert [(h.start, h.end) for h in row.hits] == [(18, 23)] and row.before == ["export function retry(n) {"] and row.after == ["}"]


def test_highlights(spark):
    df = spark.createDataFrame([("😀 aa a",), (None,), ("x" * 500 + "a" + "y" * 500,)], "t string")
    got = [r[0] for r in df.select(structure.highlight_column(df.t, [(0, "(?iud)a+")])).collect()]
    assert [(h.start, h.end) for h in got[0].hits] == [(3, 5), (6, 7)] and got[0].clipped == "😀 aa a"
    assert got[1].hits == [] and got[1].clipped is None
    assert len(got[2].clipped) == 402 and got[2].clipped[81] == "a"


def test_symbols_as_text(corpus):
    assert FileSearch(corpus, "sym:helper").symbols_as_text() == 1 and FileSearch(corpus, "helper").symbols_as_text() is None


def test_at(spark, history):
    from corpuscope import api

    trees = spark.createDataFrame([("app", "c1", "a.py", "old text"), ("app", "c2", "a.py", "new text"), ("lib", "d1", "b.py", "lib text")], "repo string, sha string, path string, content string")
    tags = spark.createDataFrame([("app", "v1", "c1")], "repo string, name string, sha string")
    at = lambda q, **k: sorted((r.path, r.text) for r in api.search(q, history=history, trees=trees, settings=Settings(now=NOW), **k).items.collect() if r.text)
    assert at("text at:2026-09-29") == [("a.py", "old text")]
    assert at("text at:2026-10") == [("a.py", "new text"), ("b.py", "lib text")]
    assert at("text at:v1", tags=tags) == [("a.py", "old text")] and at("text at:c2") == [("a.py", "new text")]


def test_classes_of_letters_in_scanned_places(corpus):
    """Patterns that Python's own module lacks, wherever texts are scanned."""
    assert lines(corpus, r"/\p{L}+off/ in:comments") == [("src/retry_test.py", 2)]
    assert lines(corpus, "word:yes backoff in:code") == [("src/client.py", 4)]
    search = FileSearch(corpus, r"/\p{Lu}elvin/", Settings(now=NOW))
    shown = search.shown(search.page()).where("line IS NOT NULL").first()
    assert [(h.start, h.end) for h in shown.hits] == [(0, 6)]
    plan = replace.plan(FileSearch(corpus, r"/(\p{L}+)ry/ -f:src", Settings(now=NOW)), "$1").collect()
    assert [(r.path, r.n) for r in plan] == [("README.md", 1)]


def test_word_edges_of_expressions(corpus):
    """An edge counts only where the match has a word character there."""
    assert lines(corpus, r"word:yes /retry\(/ type:code") == [("src/retry.ts", 2)]
    assert lines(corpus, r"word:yes /etry/ type:code") == []


def test_hidden_without_filters(corpus, history):
    assert FileSearch(corpus, "retry", Settings(now=NOW)).hidden().collect() == []
    assert CommitSearch(history, "type:commit retry", Settings(now=NOW)).hidden().collect() == []


def test_sections_of_definitions(corpus):
    rows = FileSearch(corpus, "sym:get OR sym:Client", Settings(now=NOW)).results().collect()
    assert sorted((r.section, r.text) for r in rows) == [(0, "Client"), (0, "get")]
    rows = FileSearch(corpus, "sym:get OR (kind:class call)", Settings(now=NOW)).results().collect()
    assert sorted((r.section, r.text) for r in rows) == [(0, "Client"), (0, "get")]
    assert FileSearch(corpus, "sym:get -in:code", Settings(now=NOW)).results().count() == 0
    assert {r.section for r in FileSearch(corpus, "retry -in:comments", Settings(now=NOW)).results().collect()} == {2}


def test_templates_beside_words(corpus):
    assert lines(corpus, 'struct:"backoff(:[c], tries=:[n])" import') == [("src/client.py", 1), ("src/client.py", 4)]
    assert lines(corpus, 'struct:"backoff(:[c])" OR struct:"def :[f](self)"') == [("src/client.py", 3), ("src/client.py", 4)]
    assert FileSearch(corpus, 'struct:"backoff(:[c])"', Settings(now=NOW)).incomplete().count() == 0


def test_notes_on_types_and_excludes(corpus):
    assert FileSearch(corpus, "type:file retry", Settings(now=NOW)).hidden_by_type().first().hidden == len(lines(corpus, "retry type:code"))
    shown = FileSearch(corpus, "retry excludes:no", Settings(now=NOW)).shown_excluded().first()
    assert (shown.shown, shown.patterns) == (2, ["vendor/**"])
    marks = lambda text: {r.path: [(h.start, h.end) for h in r.hits] for s in [FileSearch(corpus, text, Settings(now=NOW))] for r in s.name_marks(s.names()).collect()}
    assert marks("type:file retry -f:test") == {"src/retry.ts": [(4, 9)]}
    assert marks("type:file f:/client") == {"src/client.py": [(4, 10)]}


def test_commit_preview(history):
    rows = CommitSearch(history, "type:commit retry -f:test", Settings(now=NOW)).preview("c1").collect()
    assert [(r.path, r.hidden) for r in rows] == [("a/new.py", False), ("b_test.py", True)]
    assert [(x.sign, x.marked) for x in rows[0].lines] == [("+", True), ("-", True)]


def test_bounded_replacements(corpus, monkeypatch):
    search = FileSearch(corpus, "retry type:code", Settings(now=NOW))
    assert replace.bounded(search, "again")[1]
    assert not replace.bounded(search, "again", most_bytes=10)[1]
    monkeypatch.setattr(replace, "MOST_MATCHES", 1)
    counts, whole = replace.bounded(search, "again")
    assert not whole and "lines" not in counts.columns


def test_commit_bounds_reach_the_scan(spark):
    search = CommitSearch(queries.adapters.order_history(spark, DATA), "type:commit since:1y ring", queries.ORDERS)
    plan = search.commits()._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan


def test_a_template_is_searched_once(spark):
    found = FileSearch(queries.adapters.pages(spark, DATA), 'struct:"<h1>:[t]</h1>"', Settings(now=NOW)).lines()
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


@pytest.fixture(scope="module")
def many(spark):
    """More results than a page may ask for by number."""
    files = spark.range(MOST_RESULTS + 10).selectExpr("'r' AS repo", "concat('f', lpad(id, 6, '0'), '.go') AS path", "'go' AS lang", "concat('a\\nring ', id) AS content")
    return Corpus(files)


def test_all_results_of_a_page(many):
    page = FileSearch(many, "ring type:code order:file count:all").page().select("path").collect()
    assert [r.path for r in page] == [f"f{k:06}.go" for k in range(MOST_RESULTS + 10)]


def test_all_results_with_marks(many):
    search = FileSearch(many, "ring type:code count:all")
    got = search.shown(search.page(), 1).selectExpr("path", "hits[0].start AS start", "before[0] AS before").collect()
    assert len({r.path for r in got}) == len(got) == MOST_RESULTS + 10 and {(r.start, r.before) for r in got} == {(0, "a")}


def test_totals_are_whole(many):
    assert FileSearch(many, "ring type:code").total().collect() == [(MOST_RESULTS + 10, False)]
    answer = api.search("ring type:code", corpus=many, offset=MOST_RESULTS)
    assert (answer.total, answer.truncated, answer.next_offset) == (MOST_RESULTS + 10, False, None)


def test_what_whole_words_hide_among_many(many):
    search = FileSearch(many, "word:yes rin type:code")
    assert (search.relaxed(word="no").total().first().total, search.total().first().total) == (MOST_RESULTS + 10, 0)


def test_templates_over_brackets_of_prose():
    """A heading may hold a bracket without its partner; in code brackets still pair up."""
    page = "<h1>Call +1 (</h1><p>535) 1</p><h1>:)</h1><h1>(a)</h1><h1>[1</h1>"
    find = lambda text, lang, t: [text[a:b] for a, b in structure.find_structures(text, lang, t)[0]]
    assert find(page, "html", "<h1>:[title]</h1>") == ["<h1>Call +1 (</h1>", "<h1>:)</h1>", "<h1>(a)</h1>", "<h1>[1</h1>"]
    assert find("f(g(1, 2), 3)", "javascript", "f(:[x], :[y])") == ["f(g(1, 2), 3)"]


def test_anchors_in_any_case(spark, tmp_path):
    rows = [(1, "THE END.\nThe end", "en", "s"), (2, "the end.\nOn the.", "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["text_regex_anchors"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, got)) == sorted(con.execute(queries.SQL["text_regex_anchors"]).fetchall()) == [("en/s/doc_1.txt", 1, "THE END."), ("en/s/doc_2.txt", 1, "the end.")]


def test_files_of_one_path(spark):
    """Each result is ranked and shown by its own file, where a table has several files of one path, or files without a repo."""
    rows = [("r", "a.go", "go", "one\nring", True), ("r", "a.go", "go", "two\nring", False), ("r", "a.go", "go", "two\nring", False), (None, "b.go", "go", "three\nring", False)]
    corpus = Corpus(spark.createDataFrame(rows, "repo string, path string, lang string, content string, open boolean"))
    search = FileSearch(corpus, "ring type:code count:all", Settings(now=NOW))
    shown = search.shown(search.page(), 1).collect()
    assert sorted((r.path, r.line, r.before[0], r.score) for r in shown) == [("a.go", 2, "one", 30), ("a.go", 2, "two", 0), ("a.go", 2, "two", 0), ("b.go", 2, "three", 0)]
    assert [r.path for r in search.regrouped(search.page()).collect()] == ["a.go", "a.go", "a.go", "b.go"]
    names = FileSearch(corpus, "go type:file count:all", Settings(now=NOW)).page().collect()
    assert [(r.path, r.score) for r in names] == [("a.go", 35), ("a.go", 5), ("a.go", 5), ("b.go", 5)]


@pytest.mark.parametrize("name", ["line_marks", "count_all", "symbol_or_kind", "all_sections"])
def test_repeated_parts_agree_with_sql(spark, tmp_path, name):
    duckdb.sql(f"COPY (SELECT p.* FROM '{DATA}/part.parquet' p, range(3)) TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    df = queries.QUERIES[name](spark, str(tmp_path))
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, con.sql(queries.SQL[name]).fetchall()))


@pytest.mark.parametrize("name", ["hidden_word", "line_marks", "count_all"])
def test_odd_parts_agree_with_sql(spark, tmp_path, name):
    """A part without its name, brand or type has no text; Turkish letters are not the plain i, neither in lines nor in their marks."""
    con = duckdb.connect()
    con.execute(f"CREATE TABLE part AS SELECT * FROM '{DATA}/part.parquet' LIMIT 0")
    rows = [(None, "Brand#1", "LARGE"), ("red ring", None, "LARGE"), ("red ring", "Brand#1", None), ("red rıng", "Brand#2", "SMALL"), ("red rİng", "Brand#2", "SMALL"), ("in ring", "Brand#2", "IN"), ("red ring", "Brand#ıN", "SMALL")]
    con.executemany("INSERT INTO part VALUES (?, ?, ?, ?, 20, 1.0)", [(k, *row) for k, row in enumerate(rows)])
    con.execute(f"COPY part TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    df = queries.QUERIES[name](spark, str(tmp_path))
    want = con.sql(queries.SQL[name]).fetchall()
    assert want and sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want))


def test_marks_as_typed_agree_with_sql(spark, tmp_path):
    """The mark is the first match in the case it was typed in, by code points; a line that has only others has none."""
    con = duckdb.connect()
    con.execute(f"CREATE TABLE part AS SELECT * FROM '{DATA}/part.parquet' LIMIT 0")
    names = ["RING red", "RING ring", "\U0001f600 ring", "\U0001f600\U0001f600 Ring ring ring", "caf\u00e9 ring", "red"]
    con.executemany("INSERT INTO part VALUES (?, ?, 'Brand RING', 'LARGE', 20, 1.0)", list(enumerate(names)))
    con.execute(f"COPY part TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    got = sorted(map(str, map(tuple, queries.QUERIES["line_marks"](spark, str(tmp_path)).collect())))
    want = con.sql(queries.SQL["line_marks"]).fetchall()
    assert {r[2] for r in want} >= {-1, 2, 5, 8} and got == sorted(map(str, want))
