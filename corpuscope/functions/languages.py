"""Programming languages by name, extension and first line; test, generated and vendored files by path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Name; other names; extensions; whole file names; interpreters of a first line.
LANGUAGES = """
python; py; .py .pyi .pyw; ; python python3 python2
typescript; ts tsx; .ts .tsx .mts .cts; ; ts-node deno
javascript; js jsx; .js .jsx .mjs .cjs; ; node
go; golang; .go; ;
c++; cpp cxx cc; .cc .cpp .cxx .c++ .hh .hpp .hxx .h++ .ipp .tpp; ;
c; ; .c .h; ;
rust; rs; .rs; ;
java; ; .java; ;
kotlin; kt; .kt .kts; ;
csharp; c# cs; .cs; ;
ruby; rb; .rb; Gemfile Rakefile; ruby
php; ; .php; ; php
swift; ; .swift; ;
scala; ; .scala .sc; ;
shell; sh bash zsh; .sh .bash .zsh; ; sh bash zsh
sql; ; .sql; ;
html; ; .html .htm; ;
css; scss less; .css .scss .less; ;
json; ; .json .jsonc; ;
yaml; yml; .yaml .yml; ;
toml; ; .toml; ;
markdown; md; .md .markdown; ;
protobuf; proto; .proto; ;
make; makefile; .mk; Makefile GNUmakefile;
docker; dockerfile; ; Dockerfile;
cmake; ; .cmake; CMakeLists.txt;
lua; ; .lua; ; lua
perl; pl; .pl .pm; ; perl
r; ; .r; ;
dart; ; .dart; ;
elixir; ex; .ex .exs; ;
haskell; hs; .hs; ;
text; txt; .txt; ;
"""
# Folders and names of tests.
TEST_FOLDERS = ["test", "tests", "__tests__", "spec", "specs", "e2e", "testdata"]
TEST_ENDINGS = "go _test; javascript .test .spec; typescript .test .spec; python _test; ruby _spec _test; java Test Tests; kotlin Test Tests; csharp Test Tests; scala Test Spec Suite; swift Test Tests; php Test; dart _test; elixir _test; rust _test _tests; c++ _test _unittest; c _test"
TEST_STARTS = "python test_; shell test_"
TEST_NAMES = ["conftest.py"]
VENDORED_FOLDERS = ["vendor", "node_modules", "third_party", "dist"]
GENERATED_ENDINGS = [".pb.go", "_gen.go", ".gen.go", ".gen.ts", "_pb2.py", "_pb2_grpc.py", "_pb2.pyi", ".min.js", ".min.css"]

_ROWS = [[x.split() for x in line.split(";")] for line in LANGUAGES.strip().splitlines()]
NAMES = {n: row[0][0] for row in _ROWS for n in [*row[0], *row[1]]}
BY_EXTENSION = {e: row[0][0] for row in _ROWS for e in row[2]}
BY_FILE = {f: row[0][0] for row in _ROWS for f in row[3]}
BY_INTERPRETER = {s: row[0][0] for row in _ROWS for s in row[4]}


def _pairs(text: str) -> dict[str, list[str]]:
    return {x.split()[0]: x.split()[1:] for x in text.split(";")}


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def folders(path: Column) -> Column:
    """The folders of a path, outermost first."""
    parts = F.split(path, "/")
    return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def detect(path: Column, content: Column | None = None) -> Column:
    """The language: by whole file name, then extension in any case, then the interpreter named in the first line."""
    base = base_name(path)
    found = F.coalesce(_lookup(BY_FILE, base), _lookup(BY_EXTENSION, F.lower(F.regexp_extract(base, r"(\.[^.]*)$", 1))))
    if content is None:
        return found
    program = F.regexp_extract(F.substring(content, 1, 256), r"^#![ \t]*(?:\S*/env(?:[ \t]+-\S+)*[ \t]+)?(?:\S*/)?([^\s/]+)", 1)
    return F.coalesce(found, _lookup(BY_INTERPRETER, program), _lookup(BY_INTERPRETER, F.regexp_replace(program, r"[0-9.]+$", "")))


def is_test(path: Column) -> Column:
    base = base_name(path)
    stem = F.regexp_replace(base, r"\.[^.]*$", "")
    lang = detect(path)
    said = F.arrays_overlap(F.transform(folders(path), F.lower), F.array(*map(F.lit, TEST_FOLDERS))) | base.isin(TEST_NAMES)
    for name, ends in _pairs(TEST_ENDINGS).items():
        for end in ends:
            said = said | ((lang == name) & stem.endswith(end) & (stem != end))
    for name, starts in _pairs(TEST_STARTS).items():
        for start in starts:
            said = said | ((lang == name) & stem.startswith(start))
    return F.coalesce(said, F.lit(False))


def is_vendored(path: Column, names: list[str] | None = None) -> Column:
    return F.arrays_overlap(folders(path), F.array(*map(F.lit, names or VENDORED_FOLDERS)))


def is_generated(path: Column, content: Column | None = None, endings: list[str] | None = None) -> Column:
    """By the name's ending, and in files by a mark in the first 1,024 characters."""
    said = F.lit(False)
    for end in endings or GENERATED_ENDINGS:
        said = said | path.endswith(end)
    if content is not None:
        head = F.substring(content, 1, 1024)
        said = said | F.contains(head, F.lit("@generated")) | (F.contains(head, F.lit("DO NOT EDIT")) & F.lower(head).contains("generated"))
    return F.coalesce(said, F.lit(False))


def nearest(word: str, names, most: int = 2) -> str | None:
    """The name within ``most`` edits, the closest first."""
    def distance(a: str, b: str) -> int:
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            left, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
        return row[-1]

    best = min(((distance(word.lower(), n), n) for n in names), default=(most + 1, None))
    return best[1] if best[0] <= most else None
