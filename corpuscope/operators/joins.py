"""Joins on ranges and times, gaps and islands, base tables with overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def innermost(points: DataFrame, ranges: DataFrame, keys: list[str], at: str, begin: str, end: str, order: str) -> DataFrame:
    """For each point the smallest range of the same keys that holds it; of equal ones the first by ``order``. The keys make it a
    hash or merge join with the range as a condition."""
    held = points.join(ranges, keys).where((F.col(begin) <= F.col(at)) & (F.col(at) <= F.col(end)))
    rest = [c for c in ranges.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct((F.col(end) - F.col(begin)).alias("size"), F.col(order).alias("o")))
    return held.groupBy(*points.columns).agg(best.alias("_r")).select(*points.columns, "_r.*")


def islands(spans: DataFrame, keys: list[str], begin: str, end: str) -> DataFrame:
    """Overlapping spans of the same keys as one: keys, ``begin``, ``end``, ``n``."""
    order = Window.partitionBy(*keys).orderBy(begin, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = F.coalesce(F.col(begin) > before, F.lit(True)).cast("int")
    marked = spans.withColumn("_new", opened).withColumn("_island", F.sum("_new").over(order))
    return marked.groupBy(*keys, "_island").agg(F.min(begin).alias("begin"), F.max(end).alias("end"), F.count("*").alias("n")).drop("_island")


def overlaid(base: DataFrame, overlay: DataFrame, masked: DataFrame, keys: list[str]) -> DataFrame:
    """The base without masked and overlaid rows, and the overlay: what a fresh build would hold."""
    gone = masked.select(*keys).union(overlay.select(*keys)).distinct()
    return base.join(gone, keys, "left_anti").unionByName(overlay)


def new_commits(after: DataFrame, before: DataFrame) -> DataFrame:
    """Commits not seen before that are also newer than everything seen: old ones that a rewrite brings are not new."""
    newest = before.groupBy("repo").agg(F.max("landed").alias("_newest"))
    return after.join(before.select("repo", "sha"), ["repo", "sha"], "left_anti").join(newest, "repo", "left").where(F.col("_newest").isNull() | (F.col("landed") > F.col("_newest"))).drop("_newest")


def cell_of_line(lines: DataFrame, cells: Column) -> DataFrame:
    """The notebook cell that holds each line, from an array of cells (number, start_line, lines) on the same row."""
    own = F.filter(cells, lambda c: (c["start_line"] <= F.col("line")) & (F.col("line") < c["start_line"] + c["lines"]))
    return lines.withColumn("cell", own[0]["number"])


def merge_owner(parents: DataFrame, tips: DataFrame, spark) -> DataFrame:
    """Which merge brought a commit in: ``repo``, ``sha``, ``merged_in``, the first merge in order of ``ord`` that reaches it off the first-parent
    line. ``parents``: repo, sha, parent, nth. ``tips``: repo, sha, ord of the first-parent line."""
    return spark.sql(
        """
        WITH RECURSIVE reach(repo, sha, merged_in, ord) AS (
          SELECT p.repo, p.parent, t.sha, t.ord FROM {tips} t JOIN {parents} p ON p.repo = t.repo AND p.sha = t.sha AND p.nth > 1
          UNION ALL
          SELECT p.repo, p.parent, r.merged_in, r.ord FROM reach r JOIN {parents} p ON p.repo = r.repo AND p.sha = r.sha
            LEFT ANTI JOIN {tips} t ON t.repo = p.repo AND t.sha = p.parent)
        SELECT r.repo, r.sha, min_by(r.merged_in, r.ord) AS merged_in
        FROM reach r LEFT ANTI JOIN {tips} t ON t.repo = r.repo AND t.sha = r.sha GROUP BY r.repo, r.sha
    """,
        parents=parents,
        tips=tips,
    )
