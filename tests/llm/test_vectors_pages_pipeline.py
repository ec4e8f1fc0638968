"""Vectors, pages and the pipeline against brute force."""

import math
import random

import numpy as np
import pytest

import corpus_pipeline
from corpuscope.llm import common, neighbours, pages, sentencepieces, vector_copies
from corpuscope.llm.registry import ORACLE_SQL, QUERIES

from .data import documents, frame, words


def vectors():
    rng = np.random.default_rng(3)
    rows = []
    for i in range(300):
        rows.append((i, rng.standard_normal(16).round(3).tolist()))
    base = rng.standard_normal(16)
    rows += [(1000 + i, (base + 0.08 * rng.standard_normal(16)).tolist()) for i in range(60)]
    rows += [(2000 + i, rows[0][1]) for i in range(12)] + [(3000, [2 * x for x in rows[1][1]])]
    rows += [(4000, None), (4001, []), (4002, [0.0] * 16), (4003, [1.0, None]), (4004, [math.nan] * 16), (4005, [math.inf] + [0.0] * 15), (4006, [1.0, 2.0]), (4007, [1.0, 2.0]), (None, rows[2][1])]
    return rows


def good(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


SCHEMA = "vec_id long, embedding array<float>, label int, v string, class string, d string, band string"


def vector_frame(spark, rows):
    return spark.createDataFrame([(i, v, None, "x", "y", "z", "w") for i, v in rows], SCHEMA)


def cosine(a, b):
    a, b = np.array(a, np.float32).astype(float), np.array(b, np.float32).astype(float)
    return float((a * b).sum() / np.sqrt((a * a).sum()) / np.sqrt((b * b).sum()))


def test_near_vectors(spark):
    rows = vectors()
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_copies.near_vectors(vector_frame(spark, rows)).collect()}
    links = {k: 0 for k in range(len(rows))}
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = rows[a][1], rows[b][1]
            if good(x) and good(y) and len(x) == len(y) and cosine(x, y) >= 0.95:
                links[a] += 1
                links[b] += 1
                up[find(a)] = find(b)
    smallest = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            smallest[find(k)] = min(smallest.get(find(k), i), i)
    want = {i: (links[k], smallest.get(find(k)), i is not None and i == smallest.get(find(k))) for k, (i, _) in enumerate(rows)}
    assert got == want
    assert vector_copies.near_vectors(vector_frame(spark, [])).count() == 0


def test_near_vectors_in_parts(spark, monkeypatch):
    """A group split into parts gives what it gives whole."""
    rows = [(i, v) for i, v in vectors() if i is not None]
    whole = sorted(tuple(r) for r in vector_copies.near_vectors(vector_frame(spark, rows)).collect())
    monkeypatch.setattr(vector_copies, "PART", 10)
    assert sorted(tuple(r) for r in vector_copies.near_vectors(vector_frame(spark, rows)).collect()) == whole


def test_planted_pairs_are_found(spark):
    """Pairs at 0.951 to 0.96 among vectors without links: bands and bounds may lose few."""
    rng = np.random.default_rng(12)
    unit = lambda x: x / np.linalg.norm(x)
    rows = [(i, rng.standard_normal(64).tolist()) for i in range(3000)]
    for i in range(300):
        a, b = unit(np.array(rows[i][1])), rng.standard_normal(64)
        b = unit(b - (b @ a) * a)
        c = rng.uniform(0.951, 0.96)
        rows.append((10_000 + i, (c * a + math.sqrt(1 - c * c) * b).tolist()))
    got = {r.vec_id: r for r in vector_copies.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert sum(got[10_000 + i].component_id == i and got[i].n_links == 1 for i in range(300)) >= 298
    assert not any(got[i].n_links for i in range(300, 3000))


def threshold_pairs(n):
    """Pairs at 0.95001 to 0.952 among vectors without links."""
    rng = np.random.default_rng(14)
    a, b = rng.standard_normal((n, 64)), rng.standard_normal((n, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b -= (b * a).sum(axis=1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    c = rng.uniform(0.95001, 0.952, n)[:, None]
    return a, c * a + np.sqrt(1 - c * c) * b


def test_no_pair_at_the_threshold_is_lost(spark):
    a, b = threshold_pairs(6_000)
    rows = [(i, v) for i, v in enumerate(a.tolist())] + [(10_000 + i, v) for i, v in enumerate(b.tolist())]
    got = vector_copies.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert got.where("n_links <> 1 OR component_id <> vec_id % 10000").count() == 0


def test_bounds_hold_at_the_threshold():
    a, b = threshold_pairs(3_000)
    for size in (2, 5, 64):
        x, y = (v[:, :size] / np.linalg.norm(v[:, :size], axis=1)[:, None] for v in (a, b))
        near = np.flatnonzero((x * y).sum(axis=1) >= 0.95)
        est = vector_copies.Estimator(size, 11)
        _, signs, factor = est.code(x[near])
        upper = est.bounds(signs, factor, est.code(y[near])[0], est.width(0.95))
        assert len(near) and (np.diag(upper) >= 0.95 - vector_copies.ROUNDING).all()


def test_bands_of_large_tables(spark, monkeypatch):
    """Above ``WHOLE`` bands find the pairs, as on a smaller table all pairs do."""
    rows = [(i, v) for i, v in vectors() if i is not None]
    whole = sorted(tuple(r) for r in vector_copies.near_vectors(vector_frame(spark, rows)).collect())
    monkeypatch.setattr(vector_copies, "WHOLE", 0)
    assert vector_copies.band_plan(300, 0.95)[1] > 1
    assert sorted(tuple(r) for r in vector_copies.near_vectors(vector_frame(spark, rows)).collect()) == whole


def test_index_prunes_where_vectors_have_structure():
    """Tight groups far from each other: probes reach little more than a query's own group, and recall stays."""
    rng = np.random.default_rng(13)
    centres = rng.standard_normal((400, 64))
    x = np.repeat(centres, 20, axis=0) + 0.15 * rng.standard_normal((8000, 64))
    coder = neighbours.Coder.fit(x, 5)
    codes = coder.codes(x)
    index, unit = neighbours.Index(codes), x / np.linalg.norm(x, axis=1)[:, None]
    hits, share = 0, []
    for q in range(0, 8000, 200):
        near = unit @ unit[q]
        near[q] = -2
        hits += len(set(np.argsort(-near)[:5].tolist()) & set(index.within(codes[q], coder.radius).tolist()))
        share.append(index.probed(codes[q], coder.radius).mean())
    assert hits >= 0.95 * 5 * 40 and np.mean(share) < 0.1


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(5)
    x, y = rng.standard_normal((200, 64)), rng.standard_normal((100, 64))
    x, y = x / np.linalg.norm(x, axis=1)[:, None], y / np.linalg.norm(y, axis=1)[:, None]
    est = vector_copies.Estimator(64, 3)
    _, signs, factor = est.code(x)
    turned = est.code(y)[0]
    error = signs @ turned.T / factor[:, None] - x @ y.T
    assert abs(error.mean()) < 0.002
    assert (est.bounds(signs, factor, turned) >= x @ y.T).all()


def test_neighbours(spark):
    rows = vectors()
    table = vector_frame(spark, rows)
    queries = table.where("vec_id % 50 = 0 OR vec_id >= 4000")
    got = {}
    for r in neighbours.nearest(table, queries, 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = total = 0
    for i, v in rows:
        if i is None or not good(v) or not (i % 50 == 0 or i >= 4000):
            assert i not in got
            continue
        want = sorted((-cosine(v, x), j) for j, x in rows if j is not None and j != i and good(x) and len(x) == len(v))[:5]
        mine = sorted(got.get(i, []))
        assert [k for k, _, _ in mine] == list(range(1, len(want) + 1))
        assert all(s == pytest.approx(cosine(v, dict(rows)[j]), abs=1e-12) for _, j, s in mine)
        hits += len({j for _, j, _ in mine} & {j for _, j in want})
        total += len(want)
    assert hits >= 0.95 * total
    assert got[4006] == [(1, 4007, pytest.approx(1.0))]
    assert [j for _, j, _ in sorted(got[0])] == [2000, 2001, 2002, 2003, 2004]  # ties by id
    assert neighbours.nearest(vector_frame(spark, []), vector_frame(spark, [])).count() == 0


def test_index_finds_the_whole_ball():
    rng = np.random.default_rng(6)
    codes = rng.integers(0, 256, (2000, 8)).astype(np.uint8)
    index = neighbours.Index(codes)
    for radius in (0, 7, 20, 27, 64):
        far = np.unpackbits(codes ^ codes[5], axis=1).sum(axis=1)
        assert index.within(codes[5], radius).tolist() == np.flatnonzero(far <= radius).tolist()


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>no";</script></head><body><nav><ul><li>Home</li></ul></nav>
<!-- <article>no</article> --><div class="ad">Buy &amp; save</div><article><h1>A  &lt;title&gt;</h1><p><b>One
 two</b><br>three<p>F&ouml;ur &#8212; 5<div class="comments">nice</div><aside>x</aside><form>name</form><blockquote>six</blockquote></article><footer>&copy;</footer>"""


def test_blocks():
    text = "\n\n".join(t for w, t in pages.blocks(PAGE) if w == "article")
    assert text == "A <title>\n\nOne two three\n\nFöur — 5\n\nsix"
    assert pages.blocks("") == [] and pages.blocks("plain &amp; simple") == [("open", "plain & simple")]
    assert pages.blocks("<p>a<div cla") == [("open", "a")]
    assert [t for w, t in pages.blocks("<main><h1>x</h1><p>y</main><p>z") if w == "main"] == ["x", "y"]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<div class="site-header">Top</div><div class="content"><div class="article-header"><h1>T</h1></div><p>a</p><div class="share-bar">s</div></div><div>end</div>', ["T", "a"]),
        ('<div id="cookie-notice">c</div><main><p>a</p><section class="comments"><p>no</p></section></main>', ["a"]),
        ('<main><div>lead</div><article><header><h1>T</h1></header><p>a</p><footer>f</footer></article></main>', ["T", "a"]),
        ('<article>a</article><article class="related">no</article><p>x</p>', ["a"]),
        ('<div itemprop="articleBody">a<p hidden>h</p></div><div style="display: none">b</div>c', ["a"]),
    ],
)
def test_parts(page, want):
    found = pages.blocks(page)
    place = next(w for w in ("article", "main") if any(x[0] == w for x in found))
    assert [t for w, t in found if w == place] == want


def test_repeated_substrings():
    rng = random.Random(1)
    for _ in range(30):
        streams = [[rng.randrange(3) for _ in range(rng.randint(0, 40))] for _ in range(4)]
        streams[1] += streams[0][:20]
        flat, page = [x for s in streams for x in s], [k for k, s in enumerate(streams) for _ in s]
        want = [False] * len(flat)
        n = pages.REPEAT
        for i in range(len(flat) - n + 1):
            if page[i] == page[i + n - 1] and any(page[j] == page[j + n - 1] != page[i] and flat[i : i + n] == flat[j : j + n] for j in range(len(flat) - n + 1)):
                want[i : i + n] = [True] * n
        assert pages.repeated(np.array(flat, np.int64), np.array(page, np.int64)).tolist() == want


def test_extract(spark):
    menu = "Home News Sport Weather Travel Culture Money Contact us today now"
    own = lambda k: " ".join(f"w{k}x{j}" for j in range(30))
    rows = [(1, "http://h.org/a", PAGE), (2, None, None), (3, "x", ""), (3, "x", "")]
    rows += [(10 + k, f"https://site.example:80/{k}", f"<div>{menu}</div><div>{own(k)}</div><div class=menu>{own(k + 100)}</div>") for k in range(5)]
    table = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, uid int")
    got = sorted((r.page_id, r.url or "", r.text, r.n_chars) for r in pages.extract(table).collect())
    assert got[0][2].startswith("A <title>") and [g[2] for g in got[1:4]] == ["", "", ""]
    assert [g[2] for g in got[4:]] == [own(k) for k in range(5)]
    assert all(len(g[2]) == g[3] for g in got)
    assert pages.extract(table.limit(0)).count() == 0


def test_extract_keeps_unique_blocks_beside_articles(spark):
    """Where a teaser is an article and the story a plain div, the host decides on the story."""
    notice = " ".join(f"n{j}" for j in range(20))
    own = lambda k: " ".join(f"w{k}x{j}" for j in range(30))
    rows = [(k, f"http://h.org/{k}", f"<div>{own(k)}</div><article>teaser {k}</article><div>{notice}</div><p>{own(k + 50)}</p><nav>{own(k + 90)}</nav>") for k in range(4)]
    got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"{own(k)}\n\nteaser {k}\n\n{own(k + 50)}" for k in range(4)}


def test_extract_finds_repeats_across_groups(spark, monkeypatch):
    """A notice on two pages of a large host goes, whatever groups they fall in."""
    text = lambda name, k: " ".join(f"{name}{k}x{j}" for j in range(20))
    rows = [(k, f"http://{'h' if k < 60 else 'i'}.org/{k}", f"<div>{text('own', k)}</div><div>{text('notice', k // 2)}</div>") for k in range(80)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {k: text("own", k) for k in range(80)}
    for size in (2 << 20, 1500):
        monkeypatch.setattr(pages, "GROUP_BYTES", size)
        assert {r.page_id: r.text for r in pages.extract(table).collect()} == want


@pytest.mark.parametrize("size", [2 << 20, 900])
def test_extract_against_brute_force(spark, monkeypatch, size):
    """Random pages of few words, with and without articles: every block against all windows of the host's other pages."""
    rng = random.Random(21)
    text = lambda n: " ".join(rng.choice("abcdefghij") + rng.choice("klm") for _ in range(n))
    shared = [text(rng.randint(5, 30)) for _ in range(8)]
    rows = []
    for k in range(90):
        parts = [("div", rng.choice(shared) if rng.random() < 0.5 else text(rng.randint(1, 40))) for _ in range(rng.randint(0, 6))]
        parts += [("nav", rng.choice(shared))] * rng.randint(0, 1) + [("article", text(20))] * rng.randint(0, 1)
        rng.shuffle(parts)
        rows.append((k, f"http://h{k % 3}.org/{k}", parts))
    want = {}
    for k, url, parts in rows:
        seen = set()
        for j, other, theirs in rows:
            if j != k and other[:9] == url[:9]:
                flat = [w for kind, t in theirs if kind != "article" for w in t.split()]
                seen |= {tuple(flat[i : i + 8]) for i in range(len(flat) - 7)}
        flat = [w for kind, t in parts if kind != "article" for w in t.split()]
        covered = [False] * len(flat)
        for i in range(len(flat) - 7):
            if tuple(flat[i : i + 8]) in seen:
                covered[i : i + 8] = [True] * 8
        out, at = [], 0
        for kind, t in parts:
            if kind == "article":
                out.append(t)
                continue
            n = len(t.split())
            if kind == "div" and sum(covered[at : at + n]) < 0.5 * n:
                out.append(t)
            at += n
        want[k] = "\n\n".join(out)
    monkeypatch.setattr(pages, "GROUP_BYTES", size)
    table = spark.createDataFrame([(k, url, "".join(f"<{kind}>{t}</{kind}>" for kind, t in parts)) for k, url, parts in rows], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in pages.extract(table.repartition(5)).collect()} == want


def test_pipeline(spark, tmp_path):
    frame(spark).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs.collect()
        if name != "pieces":
            assert docs.columns == columns
    letters = [r for r in documents() if r[1] and any(c.isalpha() for c in r[1])]
    assert sorted(str(r.doc_id) for r in kept["language"]) == sorted(str(r[0]) for r in letters)
    ids = {r.doc_id for r in kept["near_copies"]}
    assert {0, 8, -3} <= ids and not {1, 2, 3, 4, 9, 11, 14, 20} & ids
    by = {r.doc_id: r for r in kept["repeats"] if r.doc_id is not None}
    assert set(by) == ids - {None} and all(r.n_chars == len(r.text) for r in by.values())
    assert len(words(by[13].text)) == 80
    assert {r.doc_id for r in kept["mixture"]} <= set(ids)
    assert sorted(str(r.doc_id) for r in kept["pieces"]) == sorted(str(r.doc_id) for r in kept["mixture"])
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(str, whole)) == sorted(map(str, kept["pieces"]))
    assert len(corpus_pipeline.STAGES) == 5


def test_registry():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES if k.startswith("op")) == list(range(1, 11))
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_links_that_bands_missed(spark, tmp_path):
    """Two vectors of sf0.1 and their turned copies: the copies lie just above 0.95 and share no band."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").where("vec_id IN (1624, 1707)")
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: (r.n_links, r.component_id) for r in QUERIES["vector_copies_turned"](spark, str(tmp_path)).collect()}
    assert got == {i + k: (2, i) for i in (1624, 1707) for k in (0, 1_000_000, 2_000_000)}


def test_workers_let_go_between_operators():
    """A worker that encoded pieces drops the vocabulary and the cache when a task of another operator begins."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    first = sentencepieces.pieces(path)
    assert sentencepieces.pieces(path) is first
    assert list(common.lean(iter([1, 2]))) == [1, 2]
    assert not common.HELD and sentencepieces.pieces(path) is not first
