"""Continuous queries over new commits, and files kept up to date by overlays."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.operators.history import CommitSearch, History
from corpuscope.operators.joins import overlaid
from corpuscope.plans.compiler import Settings


def watch_matches(commits: DataFrame, changes: DataFrame, queries: dict[str, str], settings: Settings, own_email: str | None = None) -> DataFrame:
    """``query``, ``repo``, ``sha``: which watched queries new commits match; one's own commits do not count."""
    fresh = commits if own_email is None else commits.where(F.lower("author_email") != own_email.lower())
    parts = [CommitSearch(History(fresh, changes), text, settings).commits().select(F.lit(name).alias("query"), "repo", "sha") for name, text in queries.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def start_watch(commits: DataFrame, changes: Callable[[DataFrame], DataFrame], queries: dict[str, str], settings: Settings, path: str, checkpoint: str, own_email: str | None = None):
    """Runs watched queries over a stream of commits (with event time ``landed``); each batch's matches are written once under ``path``. Commits that come twice count once
    within the watermark. ``changes`` gives a batch's changed files."""
    def batch(df: DataFrame, number: int) -> None:
        watch_matches(df, changes(df), queries, settings, own_email).write.mode("overwrite").parquet(f"{path}/batch={number}")

    unique = commits.withWatermark("landed", "30 days").dropDuplicatesWithinWatermark(["repo", "sha"])
    return unique.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def retained(commits: DataFrame, oldest: datetime) -> DataFrame:
    """The commits that the window of history keeps."""
    return commits.where(F.col("landed") >= F.lit(oldest))


def latest(events: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of superseded events only the last for each key."""
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_e")).select(*keys, "_e.*")


def apply_changes(base: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """A file table after saves and deletions: the last change of a path wins; ``deleted`` rows only mask."""
    last = latest(changes, keys, order)
    return overlaid(base, last.where("NOT deleted").select(*base.columns), last.where("deleted"), keys)


def swept(listed: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, ``deleted``: files to read again because their time changed or they are new, and files that are gone."""
    both = listed.select(*keys, F.col("mod_time").alias("_new")).join(held.select(*keys, F.col("mod_time").alias("_old")), keys, "full_outer")
    return both.where(~F.col("_new").eqNullSafe(F.col("_old"))).select(*keys, F.col("_new").isNull().alias("deleted"))
