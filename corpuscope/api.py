"""The calls a user makes: parse, search, and what to do with results."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.functions import dates, languages
from corpuscope.operators.files import Corpus, FileSearch
from corpuscope.operators.history import CommitSearch, History, as_of
from corpuscope.operators.lookup import shifted_line
from corpuscope.plans.compiler import Settings
from corpuscope.plans.query import OPERATORS, RETIRED, Query, parse


@dataclass
class Answer:
    """``items``: a page of results. ``total`` counts all results, so ``truncated`` is false; ``next_offset`` is where the next page begins, or None."""

    items: DataFrame
    total: int
    truncated: bool
    next_offset: int | None
    search: FileSearch | CommitSearch


def at_revision(value: str, trees: DataFrame, history: History, tags: DataFrame | None, settings: Settings) -> DataFrame:
    """The files that ``at:`` names: of the newest commits up to the end of a period, or of a tag or commit in each repo. ``trees``: repo, sha, path, content; ``tags``: repo, name, sha."""
    if dates.is_window(value):
        when = min(dates.until(settings.now, value), settings.now)
        chosen = as_of(history.commits, F.lit(when)).select("repo", "sha")
    else:
        named = history.commits.where(F.startswith("sha", F.lit(value))).select("repo", "sha") if tags is None else tags.where(F.col("name") == value).select("repo", "sha")
        chosen = named
    files = trees.join(chosen, ["repo", "sha"])
    return files.withColumn("lang", languages.detect(F.col("path"), F.col("content"))).drop("sha")


def search(
    text: str, corpus: Corpus | None = None, history: History | None = None, settings: Settings | None = None, offset: int = 0, trees: DataFrame | None = None, tags: DataFrame | None = None
) -> Answer:
    """Runs a query over current files, over files of the past with ``at:``, or, where it says so, over commits."""
    query = parse(text)
    if "at" in query.options:
        if trees is None or history is None:
            raise ValueError("at: needs the trees of revisions and a history")
        files = at_revision(query.options["at"], trees, history, tags, settings or Settings())
        corpus = Corpus(files, corpus.owners if corpus else None, corpus.excludes if corpus else [])
    if query.commits:
        if history is None:
            raise ValueError("this query searches commits and no history is given")
        found: FileSearch | CommitSearch = CommitSearch(history, query, settings)
        total = found.commits().count()
    else:
        if corpus is None:
            raise ValueError("this query searches files and no corpus is given")
        found = FileSearch(corpus, query, settings)
        total = found.results().count()
    count = query.options.get("count")
    size = total if count == "all" else int(count or found.settings.count)
    return Answer(found.page(offset), total, False, offset + size if offset + size < total else None, found)


def batches(items: DataFrame, size: int = 200) -> Iterator[list]:
    """Results in batches as they come."""
    held = []
    for row in items.toLocalIterator(prefetchPartitions=True):
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def as_text(items: DataFrame, form: str = "text") -> DataFrame:
    """One column ``value``: ``text`` (path:line: text), ``vimgrep`` (with a column), ``json`` or ``markdown`` (by file)."""
    line = F.coalesce(F.col("line").cast("string"), F.lit("0"))
    if form == "json":
        return items.select(F.to_json(F.struct(*[c for c in items.columns if c != "file"])).alias("value"))
    if form == "markdown":
        rows = F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: F.concat(F.lit("- "), F.coalesce(x["line"].cast("string"), F.lit("")), F.lit(": `"), F.coalesce(x["text"], F.lit("")), F.lit("`")))
        return items.groupBy("repo", "path").agg(rows.alias("r")).select(F.concat(F.lit("## "), "repo", F.lit("/"), "path", F.lit("\n"), F.array_join("r", "\n")).alias("value"))
    middle = F.concat(line, F.lit(":1")) if form == "vimgrep" else line
    return items.select(F.concat_ws(":", "path", middle, F.coalesce("text", F.lit(""))).alias("value"))


#: A part of a query between spaces, with what quotes and slashes keep together.
_PART = re.compile(r'(?:"(?:\\.|[^"\\])*"?|(?<=[\s:(-])/(?:\\.|[^/\\])+/|^/(?:\\.|[^/\\])+/|[^\s"])+')


def with_option(text: str, name: str, value: str | None) -> str:
    """The query with a whole-query option set, or without it. The rest stays as it was typed."""
    names = {name} | {o.short for o in OPERATORS.values() if o.name == name and o.short}
    if name in parse(text).options:
        for m in reversed(list(_PART.finditer(text))):
            if m[0].lower().partition(":")[0] in names and ":" in m[0]:
                before, after = text[: m.start()], text[m.end() :]
                text = before + after[1:] if after[:1] == " " and (not before or before.endswith(" ")) else before.removesuffix(" ") + after
    return text if value is None else f"{text} {name}:{value}".strip()


def ago(then: datetime, now: datetime) -> str:
    """How long ago in its largest whole unit: "3 days ago"."""
    seconds = (now - then).total_seconds()
    for size, unit in ((365 * 86400, "year"), (30 * 86400, "month"), (7 * 86400, "week"), (86400, "day"), (3600, "hour"), (60, "minute")):
        n = int(seconds // size)
        if n >= 1:
            return f"{n} {unit}{'' if n == 1 else 's'} ago"
    return "just now"


def ago_column(then, now: datetime):
    """``ago`` as a column."""
    seconds = F.unix_timestamp(F.lit(now)) - F.unix_timestamp(then)
    out = F.when(then.isNotNull(), F.lit("just now"))
    for size, unit in ((60, "minute"), (3600, "hour"), (86400, "day"), (7 * 86400, "week"), (30 * 86400, "month"), (365 * 86400, "year")):
        n = F.floor(seconds / size)
        out = F.when(n >= 1, F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))).otherwise(out)
    return out


def resolved(labels: DataFrame, column: str, value: str) -> str | None:
    """The one label of a column that an ``author:`` or ``repo:`` value means: the only one with it, or the one equal to it ignoring case."""
    low = F.lower(column)
    found = labels.where(F.contains(low, F.lit(value.lower()))).select(column).distinct().orderBy(low != value.lower(), column).limit(2).collect()
    return found[0][0] if found and (len(found) == 1 or found[0][0].lower() == value.lower()) else None


def definitions_query(name: str) -> str:
    """The definitions named exactly so."""
    return f"sym:/^{_escaped(name)}$/"


def uses_query(name: str) -> str:
    """The lines that use a name as a whole word."""
    plain = re.fullmatch(r"[\w.]+", name) and name not in ("AND", "OR", "NOT")
    return f"ref:{name}" if plain else "ref:" + _phrase(name)


def selection_query(selection: str, most: int = 500) -> str | None:
    """A query for a selected text: a phrase, or over several lines a regular expression; None for one too long or empty."""
    kept = [x.strip() for x in selection.splitlines() if x.strip()]
    if not kept or len(selection) > most:
        return None
    return _phrase(kept[0]) if len(kept) == 1 else "/" + r"\n\s*".join(map(_escaped, kept)) + "/"


def _phrase(text: str) -> str:
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"'


def _escaped(text: str) -> str:
    return re.sub(r"([\\^$.*+?()\[\]{}|/])", r"\\\1", text)


def permalinks(items: DataFrame, pushed: DataFrame, bases: dict[str, str]) -> DataFrame:
    """Results with ``url``: the line at the repository's pushed commit. ``pushed``: repo, sha, path, hunks of the current file against that commit (new_start,
    new_count, old_count); ``bases``: repo to the address before ``/blob``. A line inside a change, or a file not pushed, has none."""
    known = items.join(pushed, ["repo", "path"], "left")
    base = F.create_map(*[F.lit(x) for kv in bases.items() for x in kv]) if bases else F.lit(None).cast("map<string,string>")
    line = shifted_line(F.coalesce("hunks", F.array().cast("array<struct<new_start:int,new_count:int,old_count:int>>")), F.col("line"))
    tail = F.when(F.col("line").isNull(), F.lit("")).otherwise(F.concat(F.lit("#L"), line.cast("string")))
    return known.withColumn("url", F.concat(F.try_element_at(base, F.col("repo")), F.lit("/blob/"), "sha", F.lit("/"), "path", tail)).drop("hunks", "sha")


def narrowed(text: str, name: str, value: str, leave_out: bool = False) -> str:
    """The query with a filter added, as picking a facet does."""
    quoted = json.dumps(value, ensure_ascii=False) if any(c.isspace() or c in '()"' for c in value) else value
    return f"{text} {'-' if leave_out else ''}{name}:{quoted}".strip()


def guide() -> list[dict]:
    """Every operator: its spellings, where it works, its values."""
    return [{"name": o.name, "short": o.short, "scope": o.scope, "whole_query": o.whole, "values": list(o.values)} for o in OPERATORS.values()]


def complete(text: str, values: dict[str, list[str]] | None = None, most: int = 10) -> list[str]:
    """What the last word may become: operators by prefix, or values of an operator, fixed ones and those given."""
    word = text.rsplit(" ", 1)[-1].lstrip("-")
    name, colon, typed = word.partition(":")
    if not colon:
        return [o.name + ":" for o in OPERATORS.values() if o.name.startswith(word.lower()) or (o.short and o.short.startswith(word.lower()))][:most]
    op = next((o for o in OPERATORS.values() if name.lower() in (o.name, o.short)), None) or OPERATORS.get(RETIRED.get(name.lower(), ""))
    listed = [*(op.values if op else ()), *((values or {}).get(op.name, []) if op else [])]
    return [v for v in listed if v.lower().startswith(typed.lower())][:most]


__all__ = ["Answer", "Corpus", "History", "Query", "Settings", "as_text", "batches", "complete", "guide", "narrowed", "parse", "search", "with_option"]
