"""Replacement plans: which edits a query's matches would get. Nothing is written."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.functions.patterns import python_pattern
from corpuscope.operators.files import FileSearch
from corpuscope.plans.query import units

MOST_MATCHES = 10_000
EDITS = "array<struct<start:int,end:int,new_text:string>>"


def expand(template: str, match: re.Match) -> str:
    """``$1``, ``${name}``, ``$$``; a group that the pattern lacks is an error."""
    def one(m: re.Match) -> str:
        if m[0] == "$$":
            return "$"
        name = m[1] or m[2]
        try:
            return match.group(int(name) if name.isdecimal() else name) or ""
        except (IndexError, KeyError):
            raise ValueError(f"the pattern has no group {name}") from None

    return re.sub(r"\$\$|\$(\d+)|\$\{(\w+)\}", one, template)


def plan(search: FileSearch, new: str) -> DataFrame:
    """``repo``, ``path``, ``digest`` of the lines the plan depends on, ``n`` and ``edits`` per line (UTF-16 offsets). Takes queries with one positive text term
    without line ends; with more than ``MOST_MATCHES`` matches there are counts and no edits."""
    terms = search._line_terms()
    if len(terms) != 1 or terms[0].op not in ("", "content") or "\\n" in terms[0].value:
        raise ValueError("a replacement needs exactly one word, phrase or regular expression")
    node = terms[0]
    pattern = python_pattern(search.terms.java(node))
    is_regex = node.form == "regex"

    @F.pandas_udf(EDITS)
    def edits(lines: pd.Series) -> pd.Series:
        out = []
        for line in lines:
            found = [m for m in pattern.finditer(line) if m.end() > m.start()]
            out.append([{"start": units(line[: m.start()]), "end": units(line[: m.end()]), "new_text": expand(new, m) if is_regex else new} for m in found])
        return pd.Series(out)

    edited = search.lines().withColumn("edits", edits("text")).where(F.size("edits") > 0)
    row = F.struct("line", "text", "edits")
    return edited.groupBy("repo", "path").agg(F.sum(F.size("edits")).cast("long").alias("n"), F.sort_array(F.collect_list(row)).alias("lines")).select("repo", "path", "n", F.sha2(F.array_join(F.col("lines.text"), "\n"), 256).alias("digest"), "lines")


def bounded(search: FileSearch, new: str, most_bytes: int = 16 << 20) -> tuple[DataFrame, bool]:
    """``plan`` within its limits: with more than ``MOST_MATCHES`` matches, or more than ``most_bytes`` of edits as JSON, the counts alone and False. What
    the plan's own operators find is summed where it lies; only two numbers come to the driver."""
    found = plan(search, new)
    n, size = found.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.length(F.to_json("lines"))), F.lit(0))).first()
    return (found, True) if n <= MOST_MATCHES and size <= most_bytes else (found.drop("lines"), False)


def checked(plan_: DataFrame) -> tuple[DataFrame, bool]:
    """The plan, or with too many matches its counts alone and False."""
    total = plan_.agg(F.sum("n")).first()[0] or 0
    return (plan_, True) if total <= MOST_MATCHES else (plan_.drop("lines"), False)
