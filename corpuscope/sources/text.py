"""Files as text: decoding, notebooks, owner and exclude files, trees of files."""

from __future__ import annotations

import json
import re
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.functions import languages

SNIFFED = 8 << 10
CELLS = "array<struct<number:int,kind:string,lang:string,start_line:int,lines:int,execution_count:int,outputs:array<string>>>"


def decode(data: bytes) -> str | None:
    """An editor's text: byte-order marks dropped, UTF-16 with a mark read, lone carriage returns as line ends, each maximal invalid sequence one U+FFFD. None
    for binary data: a NUL early on without a UTF-16 mark."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        text = data[2:].decode("utf-16-le" if data[:2] == b"\xff\xfe" else "utf-16-be", "replace")
    elif b"\0" in data[:SNIFFED]:
        return None
    else:
        text = data.removeprefix(b"\xef\xbb\xbf").decode("utf-8", "replace")
    return re.sub("\r(?!\n)", "\n", text)


def decoded(content: Column) -> Column:
    @F.pandas_udf("string")
    def run(data: pd.Series) -> pd.Series:
        return data.map(lambda b: None if b is None else decode(bytes(b)))

    return run(content)


def read_tree(spark: SparkSession, root: str, repo: str, repo_ord: int = 0, most_kb: int = 1024) -> DataFrame:
    """The text files under a folder that Spark can read, of up to ``most_kb``, with language and definitions left to be added."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.col("length") <= most_kb * 1024)
    prefix = re.escape(str(PurePosixPath(root.split(":", 1)[-1])))
    path = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), f"^{prefix}/?", "")
    files = raw.select(F.lit(repo).alias("repo"), F.lit(repo_ord).alias("repo_ord"), path.alias("path"), F.col("modificationTime").alias("last_at"), decoded(F.col("content")).alias("content"))
    return files.where("content IS NOT NULL AND path NOT LIKE '.git/%'").withColumn("lang", languages.detect(F.col("path"), F.col("content")))


def notebook(text: str, outputs: bool = True) -> dict | None:
    """A notebook's text and cells: the sources one after another, then the printed outputs. None if it is none."""
    try:
        raw = json.loads(text)
        listed = raw["cells"]
    except (ValueError, KeyError, TypeError):
        return None
    joined = lambda x: "".join(x) if isinstance(x, list) else str(x or "")
    lang = ((raw.get("metadata") or {}).get("kernelspec") or {}).get("language") or "python"
    parts, cells, line, printed = [], [], 1, []
    for number, cell in enumerate(listed, 1):
        source = joined(cell.get("source")).removesuffix("\n")
        kind = cell.get("cell_type", "raw")
        count = source.count("\n") + 1
        shown = cell.get("outputs") or []
        cells.append({"number": number, "kind": kind, "lang": lang if kind == "code" else "markdown" if kind == "markdown" else "text", "start_line": line, "lines": count, "execution_count": cell.get("execution_count"), "outputs": [o.get("output_type", "") for o in shown]})
        parts.append(source)
        line += count
        printed += [(number, joined(o.get("text") or (o.get("data") or {}).get("text/plain"))) for o in shown]
    for number, out in printed if outputs else []:
        out = out.removesuffix("\n")
        if out:
            cells.append({"number": number, "kind": "output", "lang": "text", "start_line": line, "lines": out.count("\n") + 1, "execution_count": None, "outputs": []})
            parts.append(out)
            line += out.count("\n") + 1
    return {"content": "\n".join(parts), "cells": cells}


def with_notebooks(files: DataFrame) -> DataFrame:
    """Adds ``cells``; notebooks' ``content`` becomes their cells' text."""
    @F.pandas_udf(f"struct<content:string,cells:{CELLS}>")
    def run(texts: pd.Series) -> pd.DataFrame:
        found = [notebook(t) if t else None for t in texts]
        return pd.DataFrame({"content": [x["content"] if x else None for x in found], "cells": [x["cells"] if x else None for x in found]})

    is_book = F.col("path").endswith(".ipynb")
    return files.withColumn("_book", run(F.when(is_book, F.col("content")))).withColumn("content", F.coalesce("_book.content", "content")).withColumn("cells", F.col("_book.cells")).drop("_book")


def owner_rules(text: str) -> tuple[list[tuple[str, list[str]]], list[int]]:
    """A CODEOWNERS file's rules in order, and the numbers of lines that are none."""
    rules, skipped = [], []
    for number, line in enumerate(text.splitlines(), 1):
        line = re.sub(r"(?:^|\s)#.*$", "", line).strip()
        if not line:
            continue
        pattern, *names = re.split(r"\s+", line.replace("\\ ", "\0"))
        pattern = pattern.replace("\0", " ")
        if pattern.startswith("!") or "[" in pattern or any(not re.fullmatch(r"@[\w.-]+(?:/[\w.-]+)?|[^@\s]+@[^@\s]+", n) for n in names):
            skipped.append(number)
        else:
            rules.append((pattern, names))
    return rules, skipped
