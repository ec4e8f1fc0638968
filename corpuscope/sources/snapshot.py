"""Saved corpora with posting lists: searches read only files that can match.

A snapshot is a folder with ``files`` (partitioned by repo, so ``repo:`` prunes), ``postings`` (a row for each trigram of a file's folded text, in
order of the trigram, so a query reads the row groups of its own), and a manifest that is written last: a folder without one, of another version, or with
other row counts is refused.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.functions.patterns import regex
from corpuscope.operators.files import Corpus
from corpuscope.plans.query import Node, Query, parse

VERSION = 1
#: Posting lists are cut to so many ranges of trigrams.
RANGES = 64


class BadSnapshot(ValueError):
    """The folder holds no whole snapshot of this version."""


def trigrams(text: Column) -> Column:
    """The distinct trigrams of a folded text, hashed. Characters that fold to others at other lengths fold alike on both sides."""
    found = F.regexp_extract_all(fold(text), F.lit("(?s)(?=(...))"), F.lit(1))  # substring() would count from the start each time
    return F.transform(F.array_distinct(found), lambda x: F.xxhash64(x))


def fold(text: Column) -> Column:
    """Small letters, with the characters that only searches that ignore case take for each other made one."""
    low = F.lower(F.upper(F.lower(text)))
    return F.translate(low, "\u212a\u017f\u0131\u03c2", "ksi\u03c3")


def needed(node: Node | None) -> list[str] | None:
    """Texts that every matching file has, of the query's AND alone; what stands under OR or NOT asks for nothing."""
    if node is None or node.kind in ("or", "not"):
        return []
    if node.kind == "and":
        return [x for k in node.kids for x in needed(k)]
    if node.kind == "text" or node.op in ("content", "ref"):
        text = node.value if node.form != "regex" else regex(node.value).required
        return [part for part in text.split("\n") if len(part) >= 3] if text else []
    return []


@dataclass
class Snapshot:
    files: DataFrame
    postings: DataFrame

    def narrowed(self, query: Query | str) -> Corpus:
        """The files that can match as code: those with all trigrams of the texts that every match has; all of them where there are none."""
        query = parse(query) if isinstance(query, str) else query
        texts = needed(query.root)
        if not texts or query.options.get("type") != "code" or query.options.get("match") == "fuzzy":
            return Corpus(self.files)
        spark = self.files.sparkSession
        wanted = spark.range(1).select(F.explode(reduce(F.array_union, [trigrams(F.lit(t)) for t in texts])).alias("gram"))
        grams = sorted({r.gram for r in wanted.collect()})  # those of the query: a few for each of its at most 1,000 characters
        if not grams:
            return Corpus(self.files)
        found = self.postings.where(F.col("gram").isin(grams)).groupBy("repo", "path").agg(F.count("*").alias("n")).where(F.col("n") == len(grams))
        return Corpus(self.files.join(found.select("repo", "path"), ["repo", "path"], "left_semi"))


def save(files: DataFrame, path: str) -> str:
    """Writes ``files`` (repo, path, content and any others; a path comes once in a repo) as a snapshot under a new name in ``path``; the manifest makes it
    visible, so a reader never sees half of one. A file without text has no postings. Returns the snapshot's folder."""
    spark, home = files.sparkSession, f"{path}/{uuid.uuid4().hex}"
    files.write.option("compression", "zstd").partitionBy("repo").parquet(f"{home}/files")
    kept = spark.read.schema(files.schema).parquet(f"{home}/files")
    postings = kept.where("content IS NOT NULL").select("repo", "path", F.explode(trigrams(F.col("content"))).alias("gram"))
    postings.repartitionByRange(RANGES, "gram", "repo", "path").sortWithinPartitions("gram", "repo", "path").write.option("compression", "zstd").parquet(f"{home}/postings")
    manifest = {"version": VERSION, "files": kept.count(), "postings": spark.read.parquet(f"{home}/postings").count(), "schema": json.loads(files.schema.json())}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{home}/manifest")
    return home


def load(spark: SparkSession, home: str) -> Snapshot:
    """A saved snapshot; raises ``BadSnapshot`` for one that is not whole or of another version."""
    from pyspark.errors import AnalysisException
    from pyspark.sql.types import StructType

    try:
        manifest = json.loads(spark.read.text(f"{home}/manifest").first()[0])
    except (AnalysisException, TypeError, ValueError) as error:
        raise BadSnapshot(f"no manifest in {home}") from error
    if manifest.get("version") != VERSION:
        raise BadSnapshot(f"version {manifest.get('version')}, not {VERSION}")
    files = spark.read.schema(StructType.fromJson(manifest["schema"])).parquet(f"{home}/files")
    postings = spark.read.schema("repo string, path string, gram long").parquet(f"{home}/postings")
    if (files.count(), postings.count()) != (manifest["files"], manifest["postings"]):
        raise BadSnapshot(f"{home} has lost rows")
    return Snapshot(files, postings)
