"""A Git repository's history as a batch source: ``spark.dataSource.register(GitLog)``, then ``read.format("git_log").load(path)``."""

from __future__ import annotations

import re
import subprocess
from datetime import UTC, datetime

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MOST_FILE, MOST_LINE = 1 << 20, 2_000
SCHEMA = """sha string, store_ord long, author_name string, author_email string, landed timestamp, committed timestamp, subject string, body string,
  changes array<struct<path:string,old_path:string,created:boolean,added:int,removed:int,lines:array<struct<sign:string,text:string>>>>"""
_FORMAT = "%x01%H%x00%aN%x00%aE%x00%at%x00%ct%x00%s%x00%b%x02"


def git(path: str, *args: str) -> str:
    done = subprocess.run(["git", "-C", path, "-c", "core.quotePath=false", *args], capture_output=True, check=True)
    return done.stdout.decode("utf-8", "replace")


def parse_patch(patch: str) -> list[tuple]:
    """The changed files of one commit from ``git log -p -U0``, lines cut at ``MOST_LINE`` and files at ``MOST_FILE`` characters."""
    out = []
    for part in re.split(r"(?m)^diff --git ", patch)[1:]:
        head, *hunks = re.split(r"(?m)^@@[^\n]*\n", part)
        names = re.match(r'"?a/(.*?)"? "?b/(.*?)"?$', head.split("\n", 1)[0])
        moved_from, moved_to = re.search(r"(?m)^rename from (.*)$", head), re.search(r"(?m)^rename to (.*)$", head)
        new, old = re.search(r"(?m)^\+\+\+ b/(.*?)\t?$", head), re.search(r"(?m)^--- a/(.*?)\t?$", head)
        path = moved_to[1] if moved_to else new[1] if new else old[1] if old else names[2] if names else ""
        lines, size = [], 0
        for hunk in hunks:
            for line in hunk.split("\n"):
                if line[:1] in ("+", "-") and size < MOST_FILE:
                    text = line[1:].removesuffix("\r")[:MOST_LINE]
                    lines.append((line[0], text))
                    size += len(text)
        out.append((path, moved_from[1] if moved_from else None, "new file mode" in head, sum(s == "+" for s, _ in lines), sum(s == "-" for s, _ in lines), lines))
    return out


class _Range(InputPartition):
    def __init__(self, start: int, size: int):
        self.start, self.size = start, size


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.rev, self.step = options["path"], options.get("rev", "HEAD"), int(options.get("commitsPerPartition", "2000"))

    def partitions(self):
        n = int(git(self.path, "rev-list", "--first-parent", "--count", self.rev))
        return [_Range(k, self.step) for k in range(0, n, self.step)]

    def read(self, partition):
        log = git(self.path, "log", "--first-parent", "-m", "-p", "-U0", "-M", "--no-color", "--use-mailmap", f"--skip={partition.start}", f"--max-count={partition.size}", f"--format={_FORMAT}", self.rev)
        when = lambda s: datetime.fromtimestamp(int(s), UTC).replace(tzinfo=None)
        for k, entry in enumerate(log.split("\x01")[1:]):
            head, _, patch = entry.partition("\x02")
            sha, name, email, authored, committed, subject, body = head.split("\0")
            yield sha, partition.start + k, name, email, when(authored), when(committed), subject, body.strip("\n"), parse_patch(patch)


class GitLog(DataSource):
    """First-parent commits, newest first, a partition for each ``commitsPerPartition``. Options: ``path``, ``rev``."""

    @classmethod
    def name(cls) -> str:
        return "git_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Reader(dict(self.options))


def tree_at(spark, path: str, rev: str, repo: str):
    """A revision's text files: ``repo``, ``sha``, ``path``, ``content``. The list of paths is the driver's, contents are read by the executors."""
    sha = git(path, "rev-parse", f"{rev}^{{commit}}").strip()
    names = [x for x in git(path, "ls-tree", "-r", "--name-only", "-z", sha).split("\0") if x]

    def contents(batches):
        for pdf in batches:
            raw = [subprocess.run(["git", "-C", path, "cat-file", "blob", f"{sha}:{p}"], capture_output=True, check=True).stdout for p in pdf.path]
            from corpuscope.sources.text import decode

            yield pdf.assign(content=[decode(b) for b in raw]).dropna(subset=["content"])

    listed = spark.createDataFrame([(repo, sha, p) for p in names], "repo string, sha string, path string")
    return listed.mapInPandas(contents, "repo string, sha string, path string, content string")


def tags(path: str, most: int = 50) -> list[tuple[str, str]]:
    """The newest tags with their commits."""
    lines = git(path, "for-each-ref", "--sort=-creatordate", f"--count={most}", "--format=%(refname:short) %(*objectname)%(objectname)", "refs/tags").splitlines()
    return [(x.split(" ")[0], x.split(" ")[1][:40]) for x in lines]


def uncommitted(path: str) -> list[str]:
    """Paths with changes that are not committed."""
    return [x[3:] for x in git(path, "status", "--porcelain", "-z", "--untracked-files=all").split("\0") if len(x) > 3]
