"""The query language: trees, options, diagnostics, patterns, dates."""

import re
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpuscope.functions import dates
from corpuscope.functions.languages import nearest
from corpuscope.functions.patterns import BadPattern, excludes_glob, owners_glob, path_glob, reads_as_glob, regex, word_edges
from corpuscope.plans.query import OPERATORS, parse


@pytest.mark.parametrize(
    ("text", "shape"),
    [
        ("a b", ("and", "w[a]", "w[b]")),
        ("a b OR c d", ("or", ("and", "w[a]", "w[b]"), ("and", "w[c]", "w[d]"))),
        ("a (b OR c) -d", ("and", "w[a]", ("or", "w[b]", "w[c]"), ("not", "w[d]"))),
        ('NOT "x \\"y\\""', ("not", 'p[x "y"]')),
        (r"/a\/b+/ f:src/", ("and", "r[a/b+]", "file:r[src/]")),
        ("f:*.py lang:py", ("and", "file:g[*.py]", "language:w[python]")),
        ('f:"a b" sym:/x+/', ("and", "file:p[a b]", "symbol:r[x+]")),
        ("https://example.org a:b", ("and", "w[https://example.org]", "author:w[b]")),
        ("foo(bar)", "w[foo(bar)]"),
        ("a AND b", ("and", "w[a]", "w[b]")),
        ("- x", ("and", "w[-]", "w[x]")),
    ],
)
def test_trees(text, shape):
    q = parse(text)
    assert q.root.shape() == shape


def test_options():
    q = parse("x case:yes count:5 order:file:desc type:code word:no")
    assert q.ok and q.options == {"case": "yes", "count": "5", "order": "file:desc", "type": "code", "word": "no"}
    assert parse("x -in:comments in:code").left_out_places == ("comments",)
    assert parse("type:commit x").commits and parse("a:jane").commits and not parse("x").commits


@pytest.mark.parametrize(
    ("text", "code"),
    [
        ("(a", "unclosed_paren"), ("a)", "unmatched_paren"), ("a ()", "empty_group"), ("a OR", "missing_operand"), ("NOT", "missing_operand"),
        ('"a', "unclosed_quote"), ("/a", "unclosed_regex"), ("fil:x", "unknown_operator"), ("s:x", "unknown_operator"), ("kind:clas", "bad_value"),
        ("a OR case:yes", "global_misplaced"), ("a case:yes case:no", "duplicate_global"), ("author:x OR sym:y", "mixed_mode_or"), ("author:x sym:y", "op_wrong_mode"),
        ("at:v1 since:2w x", "op_with_at"), ("/a(/", "invalid_regex"), ("-a", "no_positive_term"), ("a" * 1001, "query_too_long"),
        ("type:commit -x", "history_full_scan"), ("a|b", "pipe_in_word"), (r"type:commit /a\nb/", "multiline_in_history"),
    ],
)
def test_diagnostics(text, code):
    assert code in [d.code for d in parse(text).diagnostics]


@pytest.mark.parametrize(("text", "fix"), [("(a", "(a)"), ("lng:go x", "language:go x"), ("kind:clas", "kind:class"), ("a|b", "(a OR b)"), ('x "y', 'x "y"')])
def test_fixes(text, fix):
    q = parse(text)
    assert fix in [d.fix for d in q.diagnostics] and parse(fix).ok


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab()\"/-|:\\ .*[]{}ORANDNTfile:lang😀\n", max_size=40))
def test_parse_never_fails(text):
    q = parse(text)
    for d in q.diagnostics:
        assert 0 <= d.start <= d.end <= len(text.encode("utf-16-le")) // 2
    if q.root:
        assert all(n.kind in ("text", "op", "and", "or", "not") for n in q.root.walk())


@pytest.mark.parametrize("bad", ["a(?=b)", "(?<=a)b", r"(a)\1", "a++", "(?>a)", "a{1001}", "[a", "(a", "a)", "*a", "a**", "\\", r"\Z", "[[:foo:]]"])
def test_what_re2_refuses(bad):
    with pytest.raises(BadPattern):
        regex(bad)


def test_pattern_facts():
    assert regex("abc+d").required in ("abc", "abc") and regex("a|b").required == "" and regex("(foo)barbaz?").required == "barba"
    assert regex("^a").anchored and regex(r"a\b").anchored and not regex("a.b").anchored
    assert regex(r"a\nb").newline and regex("[^a]").newline and regex(r"\s").newline and regex("(?s)a.b").newline and not regex("[a-z]+").newline
    assert regex("x*").nullable and not regex("x+").nullable
    assert regex("Ab").capital and not regex(r"\Sb").capital
    assert regex("a$").java == r"a\z" and regex(r"\s").java == r"[\t\n\f\r ]"


@pytest.mark.parametrize(
    ("glob", "yes", "no"),
    [("*.go", "cmd/main.go", "main.gox"), ("src/*.ts", "web/src/app.ts", "src/a/b.ts"), ("src/**/x", "src/a/b/x", "src/x/y"), ("a?c", "abc", "a/c")],
)
def test_path_globs(glob, yes, no):
    assert re.search(path_glob(glob).replace("\\z", "\\Z"), yes) and not re.search(path_glob(glob).replace("\\z", "\\Z"), no)


@pytest.mark.parametrize(
    ("pattern", "yes", "no"),
    [("*.js", ["a.js", "x/a.js"], ["a.jsx"]), ("/docs/", ["docs/a", "docs/b/c"], ["x/docs/a", "docs"]), ("docs/*", ["docs/a"], ["docs/a/b"]), ("apps/", ["apps/x", "a/apps/x"], ["apps"]), ("src/a", ["src/a", "src/a/b"], ["x/src/a"])],
)
def test_owner_globs(pattern, yes, no):
    p = re.compile(owners_glob(pattern).replace("\\z", "\\Z"))
    assert all(p.search(x) for x in yes) and not any(p.search(x) for x in no)


def test_exclude_globs():
    p = re.compile(excludes_glob("**/{node_modules,dist}").replace("\\z", "\\Z"))
    assert p.search("a/node_modules/x/y") and p.search("dist") and not p.search("a/distx")


def test_reading_globs():
    assert reads_as_glob("*.py", False) and reads_as_glob("a*b", True) and not reads_as_glob("a.*b", True) and not reads_as_glob("docs?", True) and not reads_as_glob(r"\*", True)


def test_word_edges():
    p = re.compile(word_edges("ab").replace(r"\p{L}\p{Nd}_", r"\w"))
    assert p.search("x ab.") and not p.search("xab") and not p.search("ab1")
    assert word_edges("-x").startswith(r"\-") and word_edges("x-").endswith("-")


NOW = datetime(2026, 10, 3, 10)


@pytest.mark.parametrize(
    ("value", "since", "until"),
    [
        ("today", datetime(2026, 10, 3), datetime(2026, 10, 4)), ("yesterday", datetime(2026, 10, 2), datetime(2026, 10, 3)),
        ("2026-09", datetime(2026, 9, 1), datetime(2026, 10, 1)), ("2026-09-30", datetime(2026, 9, 30), datetime(2026, 10, 1)),
        ("6m", datetime(2026, 4, 3, 10), datetime(2026, 4, 3, 10)), ("2w", datetime(2026, 9, 19, 10), datetime(2026, 9, 19, 10)),
        ("90min", datetime(2026, 10, 3, 8, 30), datetime(2026, 10, 3, 8, 30)), ("1y", datetime(2025, 10, 3, 10), datetime(2025, 10, 3, 10)),
    ],
)
def test_windows(value, since, until):
    assert dates.is_window(value) and dates.since(NOW, value) == since and dates.until(NOW, value) == until


def test_months_run_over():
    assert dates.add_months(datetime(2026, 3, 31), -1) == datetime(2026, 3, 3)
    assert not dates.is_window("2026-13") and not dates.is_window("soon")


def test_nearest():
    assert nearest("pythn", ["python", "go"]) == "python" and nearest("zzzzzz", ["python"]) is None


def test_every_operator_is_read():
    for op in OPERATORS.values():
        value = op.values[0] if op.values else {"window": "2w", "count": "5", "language": "go", "template": '"f(:[x])"'}.get(op.reads, "x1")
        assert not [d for d in parse(f"word {op.name}:{value}").diagnostics if not d.warning], op.name
