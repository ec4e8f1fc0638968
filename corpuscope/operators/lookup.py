"""Finding definitions by name, and windows of text around a result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.functions import languages
from corpuscope.functions.patterns import quoted
from corpuscope.plans.compiler import text_lines


def find_symbols(files: DataFrame, name: str, lang: str | None = None, most: int = 20) -> DataFrame:
    """Definitions whose names are, start with, contain, or have in order the letters of ``name``, in this order; tests, vendored and generated files last, then
    shorter names. With ``lang`` the same language only."""
    df = files.select("repo", "path", "lang", F.explode("symbols").alias("s")).select("repo", "path", "lang", "s.*")
    low, want = F.lower("name"), name.lower()
    letters = ".*".join(quoted(c) for c in want)
    rank = F.when(low == want, 0).when(F.startswith(low, F.lit(want)), 1).when(F.contains(low, F.lit(want)), 2).when(low.rlike(letters), 3)
    path = F.col("path")
    marked = languages.is_test(path) | languages.is_vendored(path) | languages.is_generated(path)
    df = df.withColumn("rank", rank).where("rank IS NOT NULL").withColumn("marked", marked)
    if lang:
        df = df.where(F.col("lang") == lang)
    return df.orderBy("marked", "rank", F.length("name"), "name", "repo", "path", "line").limit(most)


def preview(files: DataFrame, repo: str, path: str, line: int, around: int = 3) -> DataFrame:
    """The lines around one: ``line``, ``text``. Only this file is read."""
    lines = text_lines(F.col("content"))
    first = F.greatest(F.lit(line - around), F.lit(1))
    window = F.slice(lines, first, F.lit(line + around) - first + 1)
    return files.where((F.col("repo") == repo) & (F.col("path") == path)).select(F.posexplode(window).alias("i", "text")).select((F.col("i") + first).alias("line"), "text")


def shifted_line(hunks, line):
    """Where a current line was in the base, from hunks (new_start, new_count, old_count) in order; null inside a change."""
    start = F.struct(F.lit(0).alias("delta"), F.lit(False).alias("inside"))
    step = lambda acc, h: F.when(line >= h["new_start"] + h["new_count"], F.struct((acc["delta"] + h["old_count"] - h["new_count"]).alias("delta"), acc["inside"].alias("inside"))).when(line >= h["new_start"], F.struct(acc["delta"].alias("delta"), F.lit(True).alias("inside"))).otherwise(acc)
    out = F.aggregate(hunks, start, step)
    return F.when(~out["inside"], line + out["delta"])
