"""Sources, places, matches over lines, the calls of the API."""

import json
import subprocess
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from corpuscope import api
from corpuscope.operators.files import Corpus, FileSearch
from corpuscope.operators.history import History, files_at
from corpuscope.plans.compiler import Settings
from corpuscope.sources import git, snapshot, text


def test_decode():
    assert text.decode(b"\xef\xbb\xbfa\rb\r\nc") == "a\nb\r\nc"
    assert text.decode("hé".encode("utf-16")) == "hé" and text.decode(b"a\0b") is None
    assert text.decode(b"a\xf0\x9f\x98z\xff") == "a�z�"


def test_notebook():
    book = {"cells": [{"cell_type": "markdown", "source": ["# T\n", "x"]}, {"cell_type": "code", "source": "a = 1\nprint(a)\n", "execution_count": 3, "outputs": [{"output_type": "stream", "text": ["1\n"]}, {"output_type": "display_data", "data": {"image/png": "x"}}]}]}
    got = text.notebook(json.dumps(book))
    assert got["content"] == "# T\nx\na = 1\nprint(a)\n1"
    assert [(c["number"], c["kind"], c["start_line"], c["lines"]) for c in got["cells"]] == [(1, "markdown", 1, 2), (2, "code", 3, 2), (2, "output", 5, 1)]
    assert text.notebook("{}") is None and text.notebook("x") is None


def test_owner_file():
    rules, skipped = text.owner_rules("# c\n*  @a @b/c\n!x @a\ndocs/ me@x.org # why\nsrc/\nbad owner\n")
    assert rules == [("*", ["@a", "@b/c"]), ("docs/", ["me@x.org"]), ("src/", [])] and skipped == [3, 6]


def test_tree(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "x.py").write_text("def f(): pass")
    (tmp_path / "a" / "b" / "run").write_bytes(b"#!/usr/bin/env python3\nx")
    (tmp_path / "a" / "bin").write_bytes(b"\0\1")
    (tmp_path / "a" / "n.ipynb").write_text(json.dumps({"cells": [{"cell_type": "code", "source": "q = 1"}]}))
    df = text.with_notebooks(text.read_tree(spark, f"{tmp_path}/a", "r"))
    got = {r.path: (r.lang, r.content, r.cells and len(r.cells)) for r in df.collect()}
    assert got == {"x.py": ("python", "def f(): pass", None), "b/run": ("python", "#!/usr/bin/env python3\nx", None), "n.ipynb": (None, "q = 1", 1)}


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("git"))
    env = {"GIT_AUTHOR_NAME": "Jane", "GIT_AUTHOR_EMAIL": "j@x.org", "GIT_COMMITTER_NAME": "Jane", "GIT_COMMITTER_EMAIL": "j@x.org", "PATH": "/usr/bin:/bin:/usr/local/bin", "HOME": path}

    def run(*args, day=1):
        when = f"2026-09-{day:02d}T10:00:00Z"
        subprocess.run(["git", "-C", path, *args], check=True, capture_output=True, env=env | {"GIT_AUTHOR_DATE": when, "GIT_COMMITTER_DATE": when})

    run("init", "-b", "main")
    for day, (name, body) in enumerate([("a.py", "x = 1\ny = 2\n"), ("a.py", "x = 3\ny = 2\n"), ("b.txt", "hello\n")], 1):
        with open(f"{path}/{name}", "w") as f:
            f.write(body)
        run("add", ".")
        run("commit", "-m", f"step {day}\n\nmore", day=day)
        if day == 1:
            run("tag", "v1")
    run("mv", "a.py", "c.py")
    run("commit", "-m", "move", day=4)
    return path


def test_git_log(spark, repo):
    spark.dataSource.register(git.GitLog)
    df = spark.read.format("git_log").option("commitsPerPartition", 3).load(repo)
    rows = df.orderBy("store_ord").collect()
    assert [r.subject for r in rows] == ["move", "step 3", "step 2", "step 1"] and rows[1].body == "more"
    assert (rows[0].changes[0].path, rows[0].changes[0].old_path) == ("c.py", "a.py")
    assert [(x.sign, x.text) for x in rows[2].changes[0].lines] == [("-", "x = 1"), ("+", "x = 3")]
    assert rows[3].changes[0].created and rows[3].changes[0].added == 2 and rows[3].landed == datetime(2026, 9, 1, 10)
    commits = df.select(F.lit("r").alias("repo"), F.lit(0).alias("repo_ord"), "store_ord", "sha", "author_name", "author_email", "landed", "subject", "body")
    changes = df.select("sha", F.explode("changes").alias("c")).select("sha", "c.path", "c.old_path", F.lit(None).cast("string").alias("now_path"), "c.lines")
    answer = api.search("type:commit f:a.py since:2026-09-02", history=History(commits, changes), settings=Settings(now=datetime(2026, 10, 3)))
    assert [r.subject for r in answer.items.collect()] == ["move", "step 2"] and answer.total == 2


def test_revisions(spark, repo):
    old = git.tree_at(spark, repo, "v1", "r")
    now = git.tree_at(spark, repo, "HEAD", "r")
    renames = spark.createDataFrame([("r", "a.py", "c.py")], "repo string, old_path string, new_path string")
    assert [(r.path, r.content, r.since_revision) for r in files_at(old, now, renames).collect()] == [("a.py", "x = 1\ny = 2\n", "renamed")]
    assert [t for t, _ in git.tags(repo)] == ["v1"] and git.uncommitted(repo) == []


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [("r", "a.py", "python", 'x = "retry"  # retry\nretry()\n\nlast'), ("r", "b.md", "markdown", "retry\nagain\nretry\nagain")]
    return Corpus(spark.createDataFrame(rows, "repo string, path string, lang string, content string"))


@pytest.mark.parametrize(("query", "want"), [("in:comments retry", [("a.py", 1), ("b.md", 1), ("b.md", 3)]), ("in:code retry lang:python", [("a.py", 2)]), ("retry -in:code lang:python", [("a.py", 1)]), (r"/retry\nagain/", [("b.md", 1), ("b.md", 3)]), (r"/y\(\)\n\nlast/", [("a.py", 2)])])
def test_places_and_lines(corpus, query, want):
    assert sorted((r.path, r.line) for r in FileSearch(corpus, query).lines().collect()) == want


def test_api(corpus):
    answer = api.search("retry count:2 order:file", corpus=corpus)
    assert (answer.total, answer.truncated, answer.next_offset) == (4, False, 2)
    assert [len(b) for b in api.batches(answer.search.ordered(), 3)] == [3, 1]
    assert sorted(r.value for r in api.as_text(answer.items).collect())[0].startswith("a.py:1:")
    assert json.loads(api.as_text(answer.items, "json").first().value)["repo"] == "r"
    assert api.as_text(answer.search.results(), "markdown").count() == 2
    with pytest.raises(ValueError, match="history"):
        api.search("author:x", corpus=corpus)


def test_query_edits():
    assert api.with_option("a case:yes", "case", "no") == "a case:no" and api.with_option("a case:yes", "case", None) == "a"
    assert api.narrowed("a", "file", "x y", True) == 'a -file:"x y"'
    assert "since:" in api.complete("x si") and api.complete("kind:c") == ["class"] and api.complete("author:j", {"author": ["jane"]}) == ["jane"]
    assert len(api.guide()) == 23


def test_options_inside_quotes_stay(spark):
    assert api.with_option('"a  b" case:yes', "case", None) == '"a  b"'
    assert api.with_option('"x case:yes y" case:yes  z', "case", "no") == '"x case:yes y"  z case:no'
    assert api.with_option("/a  b/ c", "case", "yes") == "/a  b/ c case:yes"


def test_times_ago(spark):
    from datetime import datetime

    now = datetime(2026, 10, 3, 10)
    cases = {datetime(2026, 10, 3, 9, 59, 30): "just now", datetime(2026, 10, 3, 9, 58): "2 minutes ago", datetime(2026, 10, 2, 9): "1 day ago", datetime(2026, 9, 20): "1 week ago", datetime(2024, 10, 1): "2 years ago"}
    assert {t: api.ago(t, now) for t in cases} == cases
    rows = spark.createDataFrame([(t,) for t in cases], "t timestamp")
    assert {r.t: r.a for r in rows.select("t", api.ago_column(rows.t, now).alias("a")).collect()} == cases


def test_seeds_and_labels(spark):
    assert api.definitions_query("a.b") == r"sym:/^a\.b$/" and api.uses_query("foo") == "ref:foo" and api.uses_query("a b") == 'ref:"a b"'
    assert api.selection_query(' x "y"\n') == r'"x \"y\""' and api.selection_query("a(\n  b") == r"/a\(\n\s*b/" and api.selection_query(" \n") is None
    labels = spark.createDataFrame([("Jane",), ("Janet",), ("Bob",)], "name string")
    assert (api.resolved(labels, "name", "jane"), api.resolved(labels, "name", "jan"), api.resolved(labels, "name", "bo")) == ("Jane", None, "Bob")


def test_permalinks(spark):
    items = spark.createDataFrame([("r", "a", 9), ("r", "a", 3), ("r", "b", 1), ("r", "a", None)], "repo string, path string, line int")
    pushed = spark.createDataFrame([("r", "c0", "a", [(3, 2, 1)])], "repo string, sha string, path string, hunks array<struct<new_start:int,new_count:int,old_count:int>>")
    got = {(r.path, r.line): r.url for r in api.permalinks(items, pushed, {"r": "https://h/r"}).collect()}
    assert got == {("a", 9): "https://h/r/blob/c0/a#L8", ("a", 3): None, ("b", 1): None, ("a", None): "https://h/r/blob/c0/a"}


def test_snapshots(spark, tmp_path):
    """A search with posting lists finds what it finds without; folders that are not whole are refused."""
    import random

    rng = random.Random(2)
    words = ["timeout", "Retry", "caf\u00e9", "\u212aelvin", "re", "ab cd", "x_y", "stra\u00dfe", "\u017fee", "\u0130stanbul"]
    rows = [(f"r{k % 3}", f"f{k}", "text", None if k == 7 else "\n".join(" ".join(rng.choice(words) for _ in range(4)) for _ in range(k % 5))) for k in range(60)]
    files = spark.createDataFrame(rows, "repo string, path string, lang string, content string")
    home = snapshot.save(files, str(tmp_path))
    saved = snapshot.load(spark, home)
    assert sorted(map(str, saved.files.select(*files.columns).collect())) == sorted(map(str, files.collect()))
    from corpuscope.operators.files import Corpus, FileSearch

    lines = lambda corpus, text: sorted((r.path, r.line) for r in FileSearch(corpus, text).lines().collect())
    for text in ("timeout type:code", "retry kelvin type:code", "(timeout OR re) -retry type:code", "/time[a-z]+/ see type:code", "case:yes Retry repo:r1 type:code", "re type:code", "caf\u00e9 type:code", "absent type:code", "STRASSE type:code", '"ab cd" type:code'):
        assert lines(saved.narrowed(text), text) == lines(Corpus(files), text), text
    assert saved.narrowed("timeout absent type:code").files.count() == 0
    with pytest.raises(snapshot.BadSnapshot):
        snapshot.load(spark, str(tmp_path))
    spark.createDataFrame([('{"version": 0}',)], "value string").write.mode("overwrite").text(f"{home}/manifest")
    with pytest.raises(snapshot.BadSnapshot):
        snapshot.load(spark, home)
