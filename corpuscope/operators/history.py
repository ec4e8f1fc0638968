"""Search over commits and their changed files."""

from __future__ import annotations

import tempfile
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuscope.functions import languages
from corpuscope.operators.files import top_labels
from corpuscope.plans.compiler import Settings, Terms, all_of, any_of, condition, conjuncts, contributing, filter_reason, truth, yes
from corpuscope.plans.query import Node, Query, parse


@dataclass
class History:
    """``commits``: repo, repo_ord, store_ord, sha, author_name, author_email, landed, subject, body.
    ``changes``: sha, path, old_path, now_path, lines (array of sign and text), and repo unless a sha tells it."""

    commits: DataFrame
    changes: DataFrame

    @property
    def keys(self) -> list[str]:
        return ["repo", "sha"] if "repo" in self.changes.columns else ["sha"]


class CommitSearch:
    """One query over a history. A commit matches if one of its changed files does, with the commit's own facts."""

    def __init__(self, history: History, query: Query | str, settings: Settings | None = None):
        self.history = history
        self.query = parse(query) if isinstance(query, str) else query
        if not self.query.ok:
            raise ValueError("; ".join(d.message for d in self.query.diagnostics if not d.warning))
        self.settings = settings or Settings()
        self.terms = Terms(self.query, self.settings)
        self.kids = conjuncts(self.query.root)
        self.side = {"added": "+", "removed": "-"}.get(self.query.options.get("type", ""))

    @staticmethod
    def message() -> Column:
        return F.concat_ws("\n", F.col("subject"), F.col("body"))

    def commit_leaf(self, node: Node) -> Column | None:
        """Leaves that a commit alone decides."""
        t = self.terms
        if node.kind != "op":
            return None
        if node.op == "author":
            name = F.lower("author_name")
            want = node.value.lower()
            return name == want if node.form == "phrase" else F.contains(name, F.lit(want)) | F.contains(F.lower("author_email"), F.lit(want))
        if node.op == "message":
            return self.message().rlike(t.java(node))
        if node.op in ("since", "until"):
            late = F.col("landed") >= F.lit(t.window(node))
            return late if node.op == "since" else ~late
        if node.op == "repo":
            return t.path_value(node, F.col("repo"))
        return None

    def hit(self, node: Node):
        """Whether a changed line, on the searched side, matches a term."""
        def test(x):
            found = self.terms.in_line(node, x["text"])
            return (x["sign"] == self.side) & found if self.side else found

        return test

    def leaf(self, node: Node) -> Column:
        whole = self.commit_leaf(node)
        if whole is not None:
            return whole
        if node.kind == "op" and node.op == "file":
            return any_of([yes(self.terms.path_value(node, F.col(c))) for c in ("path", "old_path", "now_path")])
        if node.kind == "op" and node.op == "language":
            return languages.detect(F.col("path")) == node.value
        if node.kind == "op" and node.op == "is":
            return {"test": languages.is_test, "vendored": languages.is_vendored, "generated": languages.is_generated}[node.value](F.col("path"))
        in_lines = yes(F.exists("lines", self.hit(node)))
        if node.kind == "text" and not self.side:
            return in_lines | self.terms.in_line(node, self.message()) if node.form != "regex" else in_lines | F.exists(F.split(self.message(), "\n", -1), lambda x: self.terms.in_line(node, x))
        return in_lines

    def _commit_only(self, node: Node) -> bool:
        return all(x.kind in ("and", "or", "not") or self.commit_leaf(x) is not None for x in node.walk())

    @cached_property
    def views(self) -> DataFrame:
        """Changed files with their commits; commits without files have one empty view. Conjuncts on the commit alone come before
        the join."""
        commits = self.history.commits
        for kid in self.kids:
            if self._commit_only(kid):
                commits = commits.where(condition(kid, self.leaf))
        return commits.join(self.history.changes, self.history.keys, "left")

    def _matching_views(self) -> DataFrame:
        df = self.views
        for kid in self.kids:
            if not self._commit_only(kid):
                df = df.where(condition(kid, self.leaf))
        return df

    FACTS = ("repo", "repo_ord", "store_ord", "sha", "author_name", "landed", "subject")

    def commits(self, most_files: int = 20) -> DataFrame:
        """Matching commits with ``n_files``, ``files`` (the first ``most_files`` by path) and ``n_lines``, the lines of matching files that a
        contributing term matches."""
        terms = [n for n in self.query.terms if n.op in ("", "content")]
        contrib = contributing(self.query.root, self.leaf, lambda n: n.term >= 0 and n.op in ("", "content"))
        lines = lambda x: any_of([contrib[n.term] & self.terms.in_line(n, x["text"]) for n in terms if n.term in contrib])
        side = (lambda x: x["sign"] == self.side) if self.side else (lambda x: F.lit(True))
        n_lines = F.coalesce(F.size(F.filter("lines", lambda x: side(x) & lines(x))), F.lit(0))
        df = self._matching_views().select(*self.FACTS, "path", n_lines.alias("_n"))
        # only the first paths of a commit are gathered, whatever it touched
        place = F.row_number().over(Window.partitionBy(*self.FACTS).orderBy(F.asc_nulls_last("path")))
        df = df.withColumn("_first", F.when(place <= most_files, F.col("path")))
        return df.groupBy(*self.FACTS).agg(F.count("path").alias("n_files"), F.sort_array(F.collect_list("_first")).alias("files"), F.sum("_n").alias("n_lines"))

    def preview(self, sha: str, most_files: int = 100) -> DataFrame:
        """A commit's changed files: ``path``, ``old_path``, ``lines`` (sign, text and whether a term of the query marks it), and ``hidden``, whether
        the query's filters leave the file out."""
        terms = [n for n in self.query.terms if n.op in ("", "content")]
        only = [k for k in self.kids if filter_reason(k) and not self._commit_only(k)]
        marks = F.transform("lines", lambda x: F.struct(x["sign"].alias("sign"), x["text"].alias("text"), any_of([self.hit(n)(x) for n in terms]).alias("marked")))
        commits = self.history.commits.where(F.startswith("sha", F.lit(sha)))
        df = commits.join(self.history.changes, self.history.keys)
        return df.select("repo", "sha", "path", "old_path", marks.alias("lines"), (~all_of([truth(k, self.leaf) for k in only])).alias("hidden")).orderBy("repo", "sha", "path").limit(most_files)

    def ordered(self) -> DataFrame:
        """Newest first; at one time earlier repos first, within a repo in the store's order."""
        return self.commits().orderBy(F.desc("landed"), "repo_ord", "store_ord")

    def page(self, offset: int = 0) -> DataFrame:
        count, rest = self.query.options.get("count"), self.ordered().offset(offset)
        return rest if count == "all" else rest.limit(int(count) if count else self.settings.count)

    def hidden(self) -> DataFrame:
        """``filter``, ``hidden``: commits that do not match, by the first filter without which one of their files would."""
        filters = [(k, n) for k, n in enumerate(self.kids) if filter_reason(n)]
        if not filters:
            return self.history.commits.sparkSession.createDataFrame([], "filter string, hidden long")
        flags = [yes(truth(n, self.leaf)).alias(f"_k{k}") for k, n in enumerate(self.kids)]
        df = self.history.commits.join(self.history.changes, self.history.keys, "left").select("repo", "sha", *flags)
        every = [F.col(f"_k{k}") for k in range(len(self.kids))]
        without = [F.bool_or(all_of([c for j, c in enumerate(every) if j != k])).alias(f"_w{k}") for k, _ in filters]
        per = df.groupBy("repo", "sha").agg(F.bool_or(all_of(every)).alias("_all"), *without).where("NOT _all")
        first = F.coalesce(*[F.when(F.col(f"_w{k}"), F.lit(self.query.text[n.start : n.end])) for k, n in filters])
        return per.select(first.alias("filter")).where("filter IS NOT NULL").groupBy("filter").agg(F.count("*").alias("hidden"))

    def facets(self, most: int = 8) -> DataFrame:
        found = self._matching_views().select(*self.FACTS).distinct()
        fields = [("repo", F.col("repo")), ("author", F.col("author_name")), ("month", F.date_format("landed", "yyyy-MM"))]
        pairs = found.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), c.alias("label")) for f, c in fields])).alias("x")).select("x.*")
        return top_labels(pairs, most, newest_first="month")


def newest_touch(changes: DataFrame, commits: DataFrame) -> DataFrame:
    """For each path the newest commit, by the store's order, that touched it."""
    facts = commits.select("repo", "sha", "store_ord", "author_name", "landed")
    return changes.join(facts, History(commits, changes).keys).groupBy("repo", "path").agg(F.min_by(F.struct("sha", "author_name", "landed"), "store_ord").alias("t")).select("repo", "path", "t.*")


def as_of(commits: DataFrame, when: Column) -> DataFrame:
    """For each repo the newest commit that landed up to ``when``; of several at one time the first in store order."""
    return commits.where(F.col("landed") <= when).groupBy("repo").agg(F.max_by("sha", F.struct("landed", -F.col("store_ord"))).alias("sha"), F.max("landed").alias("landed"))


def files_at(tree: DataFrame, current: DataFrame, renames: DataFrame | None = None) -> DataFrame:
    """A revision's files with ``since_revision``: changed, deleted or renamed against the current texts, or null."""
    now = current.select("repo", F.col("path").alias("now_path"), F.col("content").alias("now_content"))
    moved = tree if renames is None else tree.join(renames.select("repo", F.col("old_path").alias("path"), F.col("new_path").alias("moved_to")), ["repo", "path"], "left")
    moved = moved if renames is not None else moved.withColumn("moved_to", F.lit(None).cast("string"))
    moved = moved.withColumn("now_path", F.coalesce("moved_to", "path"))
    state = F.when(F.col("now_content").isNull(), "deleted").when(F.col("moved_to").isNotNull(), "renamed").when(F.col("now_content") != F.col("content"), "changed")
    return moved.join(now, ["repo", "now_path"], "left").withColumn("since_revision", state).drop("now_content", "moved_to")


def names_over_time(renames: DataFrame) -> DataFrame:
    """Where a path of the past is now: ``repo``, ``path``, ``now_path`` from ``renames`` (repo, ord from oldest, old_path, new_path).

    A rename goes on with the next later one of its new path; a path that was renamed more than once is the one of its last. Each round follows
    chains twice as far, from a checkpoint, until none goes on.
    """
    first = renames.select("repo", "ord", F.col("old_path").alias("path"), F.col("new_path").alias("now_path"))
    later = renames.select("repo", F.col("ord").alias("_ord"), F.col("old_path").alias("now_path"), F.col("new_path").alias("_path"))
    at = F.struct("_ord", F.col("now_path").alias("old"), F.col("_path").alias("now"))
    step = first.join(later, ["repo", "now_path"]).where("_ord > ord").groupBy("repo", "ord", "path").agg(F.min(at).alias("to"))
    now = cut(first.join(step, ["repo", "ord", "path"], "left"))
    while now.where("to IS NOT NULL").limit(1).count():
        target = now.select("repo", F.col("ord").alias("_ord"), F.col("path").alias("_old"), F.col("now_path").alias("_now"), F.col("to").alias("_next"))
        met = now.withColumns({"_ord": F.col("to._ord"), "_old": F.col("to.old")}).join(target, ["repo", "_ord", "_old"], "left")
        now = cut(met.select("repo", "ord", "path", F.coalesce("_now", "now_path").alias("now_path"), F.col("_next").alias("to")))
    return now.groupBy("repo", "path").agg(F.max_by("now_path", "ord").alias("now_path"))


def cut_dir(spark: SparkSession) -> str:
    """The folder for checkpoints that the session names, or on a single machine a private one."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="corpuscope-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """The rows from a checkpoint."""
    cut_dir(df.sparkSession)
    return df.checkpoint()
