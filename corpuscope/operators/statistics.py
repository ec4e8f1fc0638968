"""Counts that completions offer: authors, message words, symbols, languages, folders, owners, windows, states."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.functions import languages

# Words too common to offer.
STOP_WORDS = "the and for with that this from into not are was has have but its you can all use when add".split()


def authors(commits: DataFrame) -> DataFrame:
    """``author_name``, ``commits``, ``emails`` (distinct, ignoring case), ``last``."""
    return commits.groupBy("author_name").agg(F.count("*").alias("commits"), F.countDistinct(F.lower("author_email")).alias("emails"), F.max("landed").alias("last"))


def message_words(commits: DataFrame, since: datetime, shortest: int = 3) -> DataFrame:
    """``phrase``, ``commits``: words and pairs of neighbouring words of subjects since a time, each once a commit. Words have
    ``shortest`` letters and are no stop words; pairs stand in more than one commit."""
    words = F.filter(F.split(F.lower("subject"), r"[^\p{L}\p{Nd}_]+"), lambda w: (F.length(w) >= shortest) & ~w.isin(STOP_WORDS))
    recent = commits.where(F.col("landed") >= F.lit(since)).select(words.alias("w"))
    pairs = F.transform(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), lambda x, i: F.concat_ws(" ", x, F.element_at("w", i + 2)))
    counts = recent.select(F.explode(F.array_distinct(F.concat("w", pairs))).alias("phrase")).groupBy("phrase").agg(F.count("*").alias("commits"))
    return counts.where((~F.contains(F.col("phrase"), F.lit(" "))) | (F.col("commits") > 1))


def symbols(files: DataFrame) -> DataFrame:
    return files.select("repo", F.explode("symbols.name").alias("name")).groupBy("name").agg(F.count("*").alias("definitions"), F.countDistinct("repo").alias("repos"))


def by_language(files: DataFrame) -> DataFrame:
    extension = F.lower(F.regexp_extract(languages.base_name(F.col("path")), r"(\.[^.]*)$", 1))
    return files.groupBy("lang").agg(F.count("*").alias("files"), F.countDistinct(extension).alias("extensions"), F.countDistinct("repo").alias("repos"))


def by_folder(files: DataFrame) -> DataFrame:
    """``folder``, ``files``: every folder counts the files in it and below. Sums per folder come before folders are taken apart."""
    parent = F.when(F.contains(F.col("path"), F.lit("/")), F.regexp_replace("path", "/[^/]*$", ""))
    direct = files.select(parent.alias("folder")).where("folder IS NOT NULL").groupBy("folder").agg(F.count("*").alias("n"))
    parts = F.split("folder", "/")
    upward = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    return direct.select(F.explode(upward).alias("folder"), "n").groupBy("folder").agg(F.sum("n").alias("files"))


def by_owner(files: DataFrame, owners: Column) -> DataFrame:
    """``owner``, ``files``: a file counts for each of its owners, once each ignoring case; ``none`` for files without."""
    owned = F.array_distinct(F.transform(owners, F.lower))
    return files.select(F.explode(F.when(F.size(owned) == 0, F.array(F.lit("none"))).otherwise(owned)).alias("owner")).groupBy("owner").agg(F.count("*").alias("files"))


def window_counts(files: DataFrame, starts: dict[str, datetime]) -> DataFrame:
    """``window``, ``changed``, ``unchanged``: files changed since each time, in one pass."""
    late = {k: F.coalesce(F.col("last_at") >= F.lit(v), F.lit(False)) for k, v in starts.items()}
    sums = files.agg(F.count("*").alias("_n"), *[F.count_if(c).alias(f"_{k}") for k, c in late.items()])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(k).alias("window"), F.col(f"_{k}").alias("changed"), (F.col("_n") - F.col(f"_{k}")).alias("unchanged")) for k in starts])).alias("x")).select("x.*")


def state_counts(files: DataFrame) -> DataFrame:
    """One row: files that are open, changed, tests, generated, vendored."""
    path, content = F.col("path"), F.col("content") if "content" in files.columns else None
    return files.agg(F.count_if(F.col("open")).alias("open"), F.count_if(F.col("dirty")).alias("changed"), F.count_if(languages.is_test(path)).alias("test"), F.count_if(languages.is_generated(path, content)).alias("generated"), F.count_if(languages.is_vendored(path)).alias("vendored"))


def completions(values: DataFrame, column: str, weight: str, prefix: str, most: int = 10) -> DataFrame:
    """The heaviest values that start with what was typed, ignoring case."""
    return values.where(F.startswith(F.lower(column), F.lit(prefix.lower()))).orderBy(F.desc(weight), column).limit(most)
