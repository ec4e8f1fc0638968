"""The operators on documents against brute force, on a table with every awkward case, and on an empty one."""

import random
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import xxhash

from corpuscope.llm import languages, mixing, near_texts, repeats, resharding, sentencepieces, simhash, wavelet
from corpuscope.llm.automaton import SuffixAutomaton
from corpuscope.llm.common import fresh_path, sifted
from corpuscope.llm.components import components

from .data import documents, frame, words

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


def roots(nodes, links):
    up = {x: x for x in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {x: find(x) for x in nodes}


# components


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(80)] + [(2000, 2001 + i) for i in range(100)]
    got = {r.node: r.root for r in components(spark.createDataFrame([*links, (None, 3), (5, 5)], "a long, b long")).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert got == roots(nodes, [x for x in links if x[0] != x[1]])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sifted(spark):
    rows = spark.range(20_000).selectExpr("id * 7 - 3 AS k", "id AS v")
    ids = spark.range(300).selectExpr("id * 91 - 3")
    want = set(range(-3, 300 * 91 - 3, 91))
    for bits in (24, 9):
        got = [r.k for r in sifted(rows, "k", ids, bits).collect()]
        assert want <= set(got) and len(got) == len(set(got)) and (bits == 9 or len(got) < 310)
    assert sifted(rows, "k", ids.limit(0)).count() == 0


# 1: resharding


def test_flow_is_cheapest():
    rng = random.Random(2)
    for _ in range(20):
        n, m = rng.randint(1, 6), rng.randint(1, 6)
        supply = [rng.randint(0, 50) for _ in range(n)]
        room = [rng.randint(0, 60) for _ in range(m)]
        room[0] += max(0, sum(supply) - sum(room))
        cost = [[rng.randint(0, 9) for _ in range(m)] for _ in range(n)]
        flow = resharding.min_cost_flow(supply, room, lambda i, j: cost[i][j])
        assert [sum(v for (i, _), v in flow.items() if i == k) for k in range(n)] == supply
        used = [sum(v for (_, j), v in flow.items() if j == k) for k in range(m)]
        assert all(u <= r for u, r in zip(used, room, strict=True))
        # cheapest exactly if no cycle of the residual graph has a negative cost; spare room is a node more
        far = [0] * (n + m + 1)
        edges = [(i, n + j, cost[i][j]) for i in range(n) for j in range(m)] + [(n + j, i, -cost[i][j]) for (i, j) in flow]
        edges += [(n + j, n + m, 0) for j in range(m) if used[j] < room[j]] + [(n + m, n + j, 0) for j in range(m) if used[j]]
        for _ in range(n + m + 1):
            far = [min([far[v], *(far[u] + c for u, w, c in edges if w == v)]) for v in range(n + m + 1)]
        assert all(far[u] + c >= far[w] for u, w, c in edges)


def test_flow_moves_fewest_bytes():
    supply, room = [70, 10, 40, 0], [30, 30, 30, 30, 30]
    flow = resharding.min_cost_flow(supply, room)
    assert sum(v for (i, j), v in flow.items() if i != j) == sum(supply) - sum(map(min, supply, room))
    with pytest.raises(ValueError, match="hold"):
        resharding.min_cost_flow([5], [4])


def test_reshard(spark, docs, empty):
    shards, plan = resharding.reshard(docs, fresh_path(spark, "t"), old_shards=3, shards=5, blocks=16)
    got = shards.collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r[0], r[1]) for r in documents())
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r["size"] == len((r.text or "").encode()) + 16
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert plan.moved == sum(b[3] for b in plan.blocks if b[0] != b[4])
    assert resharding.reshard(empty, fresh_path(spark, "t"), 3, 5)[0].count() == 0


def test_reshard_balances():
    rng = random.Random(3)
    sizes = [(o, b, 1, int(rng.paretovariate(1.5) * 100)) for o in range(8) for b in range(200)]
    plan = resharding.plan_moves(sizes, 11)
    load = Counter()
    for b in plan.blocks:
        load[b[4]] += b[3]
    assert max(load.values()) - min(load.values()) < 0.02 * sum(load.values()) / 11


def test_reshard_all_documents(spark, docs, tmp_path):
    """The registered query, with its 32 old shards and 40 new ones, against the rows themselves."""
    docs.select("doc_id", "text", "source").write.parquet(f"{tmp_path}/documents.parquet")
    got = resharding.op1_reshard(spark, str(tmp_path)).collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 16, None if r[1] is None else zlib.crc32(r[1].encode())) for r in documents())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)} and {r.shard for r in got} <= set(range(40))
    slots, load = defaultdict(list), Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        load[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    # what is too large for an equal share stands alone; the others differ by less than one of the documents
    alone = {r.shard for r in got if r["size"] > sum(load.values()) / 40}
    assert all(len(slots[s]) == 1 for s in alone)
    # one plan, whatever the input's partitions
    assert sorted(resharding.reshard(docs.repartition(3), fresh_path(spark, "t"), 32, 40)[1].blocks) == sorted(resharding.reshard(docs, fresh_path(spark, "t"), 32, 40)[1].blocks)


def test_reshard_keeps_columns_of_any_name(spark):
    table = spark.createDataFrame([(1, "a", 5, 6, 7), (None, "bb", 8, 9, 1)], "doc_id long, text string, _block int, _FILE int, _old_shard int")
    got, _ = resharding.reshard(table, fresh_path(spark, "t"), 3, 2, blocks=4)
    assert got.columns == [*table.columns, "size", "shard", "slot"]
    assert sorted((r[0] or 0, *r[1:6]) for r in got.collect()) == [(0, "bb", 8, 9, 1, 18), (1, "a", 5, 6, 7, 17)]


def test_rewrite_only_affected(spark):
    rows = [(i, "t" * (i % 17)) for i in range(200)]
    laid = resharding.placed(spark.createDataFrame(rows, "doc_id long, text string").withColumn("size", resharding.text_size(resharding.F.col("text"))), 4, 8)
    sizes = resharding.block_sizes(laid)
    still = resharding.Plan([(o, b, n, s, o, 0) for o, b, n, s in sizes], {}, 4)
    assert still.affected == set()
    path = fresh_path(spark, "t")
    first = [(o, b, n, s, o, 0) for o, b, n, s in sizes]
    resharding.rewrite(laid, resharding.Plan(first, {}, 4), path)
    moved = [(o, b, n, s, 3 if (o, b) == (0, 0) else o, 0) for o, b, n, s in sizes]
    plan = resharding.Plan(moved, {}, 4)
    assert plan.affected == {0, 3}
    after = resharding.rewrite(laid, plan, path, only=plan.affected)
    assert sorted(r.doc_id for r in after.collect()) == list(range(200))


# 2: SimHash


def brute_fingerprint(text):
    b = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    w = b.split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << i for i in range(64) if sum(x >> i & 1 for x in h) * 2 > len(h))


def test_simhash(docs, empty):
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.fp % 2**64, r.component_id) for r in simhash.near_copies(docs).collect()), key=str)
    rows = [(r[0], brute_fingerprint(r[1])) for r in documents() if len(r[1] or "") < 90_000] + [(r[0], simhash.fingerprint(r[1].encode())) for r in documents() if len(r[1] or "") >= 90_000]
    fps = {f for _, f in rows}
    root = roots(fps, [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2])
    smallest = {}
    for i, f in rows:
        if i is not None:
            smallest[root[f]] = min(smallest.get(root[f], i), i)
    assert got == sorted(((i is None, i or 0, f, smallest.get(root[f])) for i, f in rows), key=str)
    assert simhash.near_copies(empty).count() == 0


@pytest.mark.parametrize("spread", [2, 6])
def test_simhash_links_in_full_buckets(spark, spread):
    """Hundreds of fingerprints around a few centres: full buckets and small ones must give the components of all pairs."""
    rng = random.Random(spread)
    fps = set()
    for _ in range(4):
        centre = rng.getrandbits(64)
        for _ in range(250):
            x = centre
            for _ in range(rng.randint(0, spread)):
                x ^= 1 << rng.choice([0, 1, 5, 17, 20, 33, 40, 50, 63, 62])
            fps.add(x - 2**64 if x >= 2**63 else x)
    fps |= {rng.getrandbits(63) for _ in range(300)}
    edges = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long")).collect()
    want = roots(fps, [(a, b) for a in fps for b in fps if a < b and ((a ^ b) % 2**64).bit_count() <= 2])
    assert all(((e.a ^ e.b) % 2**64).bit_count() <= 2 for e in edges)
    assert roots(fps, [(e.a, e.b) for e in edges]) == want


def test_wide_simhash(spark, docs, empty):
    got = {r.doc_id: r.component_id for r in near_texts.near_duplicates(docs).collect()}
    rows = [(r[0], r[1] or "") for r in documents() if r[0] is not None]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} - {()} for w in ([x.lower() for x in words(t)] for _, t in rows)]
    links = []
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if rows[a][1] == rows[b][1] or both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                links.append((rows[a][0], rows[b][0]))
    want = roots({i for i, _ in rows}, links)
    assert {i: got.get(i, i) for i in want} == want
    assert near_texts.near_duplicates(empty).count() == 0
    stay = near_texts.without_copies(docs)
    assert stay.columns == docs.columns
    assert {r.doc_id for r in stay.collect() if r.doc_id is not None} == set(want.values())


def test_wide_simhash_in_large_groups(spark):
    """Copies with a word changed here and there, all around one text: they must come together."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    rows = []
    for i in range(400):
        t = list(base)
        t[rng.randrange(200)] = f"new{i}"
        rows.append((i, " ".join(t)))
    rows += [(1000 + i, " ".join(f"v{rng.randrange(9000)}" for _ in range(200))) for i in range(200)]
    got = {r.doc_id: r.component_id for r in near_texts.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {got[i] for i in range(400)} == {0}
    assert not [i for i, c in got.items() if i >= 1000 and c != i]


def template_texts(n, shared):
    """``n`` texts of 300 words that have the first ``shared`` in common; every second one is a near copy (0.84) of the one before it."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(10**6)}"
    base, rows = [word() for _ in range(shared)], []
    for i in range(0, n, 2):
        text = base + [word() for _ in range(300 - shared)]
        rows += [(i, " ".join(text)), (i + 1, " ".join(text[:-25] + [word() for _ in range(25)]))]
    return rows


def test_wide_simhash_among_texts_of_a_template(spark):
    """A refused pair of a group's forest must not hide the true links of the group."""
    got = {r.doc_id: r.component_id for r in near_texts.near_duplicates(spark.createDataFrame(template_texts(200, 225), "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i in range(200)}


def test_wide_simhash_in_large_groups_of_a_template(spark):
    """In groups far over ``AHEAD`` every pair is compared: what is lost is what the segments lose."""
    got = {r.doc_id: r.component_id for r in near_texts.near_duplicates(spark.createDataFrame(template_texts(1000, 225), "doc_id long, text string")).collect()}
    assert sum(got.get(i + 1) != i for i in range(0, 1000, 2)) <= 2
    assert not [i for i, c in got.items() if c != i - i % 2]


def scattered(families, copies, length, changes, seed=19):
    """Families of texts around a base, each with some of its words changed here and there."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(10**6)}"
    rows = []
    for _ in range(families):
        base = [word() for _ in range(length)]
        for _ in range(copies):
            t = list(base)
            for k in rng.sample(range(length), rng.choice(changes)):
                t[k] = word()
            rows.append((len(rows), " ".join(t)))
    return rows


@pytest.mark.parametrize(("families", "copies", "changes"), [(150, 5, range(5)), (2, 400, range(1, 4)), (1, 700, range(1, 10))])
def test_wide_simhash_loses_no_link_of_families(spark, monkeypatch, families, copies, changes):
    """The components of all pairs, in small groups and in those that come together in parts."""
    monkeypatch.setattr(near_texts, "PART_ROWS", 150)
    rows = scattered(families, copies, 120, list(changes))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    links = []
    for a in range(len(rows)):
        for b in range(a - a % copies, a):
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                links.append((a, b))
    want = roots(range(len(rows)), links)
    got = {r.doc_id: r.component_id for r in near_texts.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: got.get(i, i) for i in want} == want


def test_roots_of_sets():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**40, 60)
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(30, 60), replace=False), rng.integers(0, 2**40, rng.integers(0, 12))])).astype(np.uint64) for _ in range(80)] + [np.zeros(0, np.uint64)] * 2
    links = [(a, b) for a in range(82) for b in range(a) if len(np.intersect1d(sets[a], sets[b])) >= 0.7 * len(np.union1d(sets[a], sets[b]))]
    want = roots(range(82), links)
    assert near_texts.roots_of(sets, 0.7, columns=16).tolist() == [want[i] for i in range(82)]


def test_segments_suffice_for_replaced_passages():
    """A replaced passage leaves pairs of words as alike as shingles; at 0.8 such texts must meet at every size."""
    rng = np.random.default_rng(2)
    far = []
    for _ in range(60):
        common, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (800, 100, 100))
        far.append(np.bitwise_count(near_texts.wide_code(np.concatenate([common, a]), 16) ^ near_texts.wide_code(np.concatenate([common, b]), 16)).sum() / 1024)
    assert near_texts.differing(0.8) == pytest.approx(np.mean(far), abs=0.006)
    for rows in (10**3, 10**5, 10**6, 10**7, 10**8):
        bits, segments = near_texts.segment_plan(rows)
        assert (1 - (1 - near_texts.differing(0.8)) ** bits) ** segments <= near_texts.MISS
        assert (1 - 0.848**bits) ** segments <= 1.2 * near_texts.MISS


def test_pairs_across_in_runs():
    rng = np.random.default_rng(3)
    run, joined = np.sort(rng.integers(0, 4, 300)), rng.integers(0, 40, 300)
    joined = joined[np.lexsort((joined, run))]
    codes = np.zeros((300, 2), np.uint64)
    got = {p for i, j in near_texts.across_in_runs(run, codes, joined, np.full(300, 5), 0.8, rows=64) for p in zip(i.tolist(), j.tolist(), strict=True)}
    assert got == {(i, j) for j in range(300) for i in range(j) if run[i] == run[j] and joined[i] != joined[j]}


def test_ring():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 2**63, (500, 2)).astype(np.uint64)
    b = a.copy()
    for row in b:
        for bit in rng.choice(128, rng.integers(0, near_texts.RADIUS + 1), replace=False):
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    assert near_texts.ring_viable(a, b).all()  # no pair within the radius is pruned
    assert near_texts.ring_viable(a, np.roll(a, 1, axis=0)).mean() < 0.1


# 3: wavelet matrices


@pytest.mark.parametrize("n", [0, 1, 7, 600, 5000])
def test_wavelet(n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.4, n) % 700).astype(np.uint32)
    w = wavelet.WaveletMatrix.load(wavelet.WaveletMatrix.build(ids, 10).dump())
    assert (w.tokens() == ids).all()
    for i in rng.integers(0, max(n, 1), 20 if n else 0).tolist():
        assert w.access(i) == ids[i]
        low, high = sorted((i, int(rng.integers(0, n + 1))))
        t = int(ids[i])
        assert w.count(t, low, high) == (ids[low:high] == t).sum()
    for t in {1, 2, 699, *ids[:3].tolist()}:
        assert w.locate(t) == np.flatnonzero(ids == t).tolist()
    assert w.count(5000) == 0
    with pytest.raises(IndexError):
        w.access(n)
    with pytest.raises(IndexError):
        w.select(3, n)


def test_wavelet_levels_above_16():
    ids = np.array([0, 1 << 19, 77, (1 << 20) - 1, 77], np.uint32)
    assert wavelet.WaveletMatrix.load(wavelet.WaveletMatrix.build(ids, 20).dump()).tokens().tolist() == ids.tolist()


def test_token_files(spark, docs, empty):
    from tokenizers import Tokenizer

    shards = wavelet.write_shards(docs, BPE, fresh_path(spark, "t"), shard_tokens=500)
    assert shards.count() > 5
    got = sorted(tuple(r) for r in wavelet.read_shards(shards).where("doc_id IS NOT NULL").collect())
    t, start, want = Tokenizer.from_file(BPE), 0, []
    for i, text in sorted(((r[0], r[1]) for r in documents()), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, (x[1] or "").encode())):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        if i is not None:
            want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == sorted(want)
    assert wavelet.read_shards(wavelet.write_shards(empty, BPE, fresh_path(spark, "t"))).count() == 0


def test_encoder_cuts_where_ids_stay():
    from tokenizers import Tokenizer

    rng, t = random.Random(6), Tokenizer.from_file(BPE)
    marks = list("abcXYZéß  ..,,'!?0189\n\t\r\x0b\x0c\x1c\x85  日😀_-$") + ["'s", " 's", "<|endoftext|>", "I'll", "...", ". ", "²", "Ⅷ", "ª"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    got = wavelet.Encoder(BPE).encode(texts)
    for text, g in zip(texts, got, strict=True):
        assert np.frombuffer(g, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


# 4: mixing


def test_mixing(docs, empty):
    clash = mixing.mix(docs.withColumn("_SRC", mixing.F.lit(1)).withColumn("_rank", mixing.F.lit(2)))
    assert clash.columns[-7:-5] == ["_SRC", "_rank"] and {(r["_SRC"], r["_rank"]) for r in clash.collect()} == {(1, 2)}
    got = mixing.mix(docs).collect()
    assert len(got) == len(documents())
    by = defaultdict(list)
    for r in got:
        assert r["size"] == len(words(r.text)) and r.taken == r.copies * r["size"] and 0 <= r.copies <= 3
        assert (r.rank, r.bin, r.src) == ("2", "6", "7")
        by[r.source].append(r)
    order = sorted((s for s in by if s is not None)) + [None]
    sizes = {s: sum(r["size"] for r in by[s]) for s in by}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    full, target = set(), {}
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        open_ = [s for s in by if s not in full]
        target = {s: 3.0 * sizes[s] for s in full} | {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if target[s] > 3 * sizes[s]}
        if not over:
            break
        full |= over
    for s, rows in by.items():
        assert {r.source_size for r in rows} == {sizes[s]}
        assert rows[0].target == pytest.approx(target[s])
        assert abs(sum(r.taken for r in rows) - target[s]) <= max(2, 0.5 * max(r["size"] for r in rows))
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda r: (str(r.doc_id), str(r.text)[:50], r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.mix(empty).count() == 0


def test_mixing_comes_near_targets(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", "d", None]), "w " * int(rng.paretovariate(1.1) * 5)) for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    for r in got:
        assert r["sum(taken)"] == pytest.approx(r["max(target)"], rel=0.002)


def test_mixing_tilts_as_a_dense_newton_does(spark):
    """Multipliers against Newton's method over single documents, in numpy: rates differ within a source and meet its target."""
    rng = random.Random(4)
    rows = [(s, int(rng.paretovariate(0.9) * 7) % 9000) for s in "abcdef" for _ in range(rng.choice([5, 60, 700]))]
    sizes = {s: np.array([n for x, n in rows if x == s], float) for s in "abcdef"}
    target = {s: float(round(sizes[s].sum() * f)) for s, f in zip("abcdef", (0.02, 0.4, 1.0, 1.7, 2.9, 3.0), strict=True)}
    cells = spark.createDataFrame([(s, n, k) for (s, n), k in Counter(rows).items()], "_src string, size long, n long")
    sources = spark.createDataFrame([(s, int(sizes[s].sum()), target[s]) for s in sizes], "_src string, words long, target double")
    got = {(r._src, r["size"]): r.rate / mixing.UNIT for r in mixing.with_rates(cells, sources, mixing.tilted(cells, sources, 3), 3).collect()}
    for s, n in sizes.items():
        u, x, lo, hi = n / n.max(), 0.0, -1e6, 1e6
        for _ in range(300):
            r = np.minimum(3, np.exp(np.minimum(x * u, 700)))
            g, h = (n * r).sum() - target[s], (n * u * r)[r < 3].sum()
            lo, hi = (x, hi) if g < 0 else (lo, x)
            x = x - g / h if h > 0 and lo < x - g / h < hi else (lo + hi) / 2
        want = np.minimum(3, np.exp(np.minimum(x * u, 700)))
        assert (n * want).sum() == pytest.approx(target[s], rel=1e-6)
        assert [got[s, int(k)] for k in n] == pytest.approx(want.tolist(), abs=2e-6)
        if s in "abde":
            assert len({got[s, int(k)] for k in n if k}) > 1


def test_mixing_with_full_sources(spark):
    rows = [(1, "a", "x " * 1000), (2, "b", "x"), (3, "c", None), (4, "d", "x x")]
    got = {r.source: (r.target, r.taken) for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), weights=(1,)).collect()}
    assert got["b"] == (3.0, 3) and got["d"] == (6.0, 6) and got["c"] == (0.0, 0)
    assert got["a"][0] == pytest.approx(994)


def test_mixing_without_words(spark):
    got = mixing.mix(spark.createDataFrame([(1, "a", ""), (2, None, None)], "doc_id long, source string, text string")).collect()
    assert [(r.target, r.taken) for r in got] == [(0.0, 0), (0.0, 0)]


# 5: repeats


def brute_repeats(rows, window=13):
    first = {}
    for i, text in rows:
        if i is not None:
            w = words(text)
            for k in range(len(w) - window + 1):
                g = tuple(w[k : k + window])
                first[g] = min(first.get(g, i), i)
    out = []
    for i, text in rows:
        w = words(text)
        gone = [False] * len(w)
        if i is not None:
            for k in range(len(w) - window + 1):
                if first[tuple(w[k : k + window])] < i:
                    gone[k : k + window] = [True] * window
        left = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i is None, i or 0, len(w), sum(gone), sha256(left).hexdigest(), left.decode()))
    return sorted(out)


@pytest.mark.parametrize("group_bytes", [2_000, 1 << 22])
def test_repeats(docs, empty, monkeypatch, group_bytes):
    monkeypatch.setattr(repeats, "GROUP_BYTES", group_bytes)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.kept_sha256, r.text) for r in repeats.strip_repeats(docs).collect())
    assert got == brute_repeats([(r[0], r[1]) for r in documents()])
    assert repeats.strip_repeats(empty).count() == 0


def test_repeats_random(spark, monkeypatch):
    monkeypatch.setattr(repeats, "GROUP_BYTES", 3_000)
    rng = random.Random(10)
    rows = [(rng.randrange(200), " ".join(rng.choice("ab") for _ in range(rng.choice([5, 13, 40, 200])))) for _ in range(150)]
    got = sorted((False, r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.text) for r in repeats.strip_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute_repeats(rows)


def test_automaton():
    rng = random.Random(11)
    for _ in range(200):
        k = rng.randint(1, 3)
        shard = [(rng.randint(0, 9), [rng.randrange(k) for _ in range(rng.randint(1, 30))]) for _ in range(4)]
        a = SuffixAutomaton(k)
        for owner, s in shard:
            a.add(s, owner)
        a.finish()
        text, least, below = [rng.randrange(k) for _ in range(40)], rng.randint(1, 6), rng.randint(0, 10)
        want = [e for e in range(least, 41) if any(o < below and text[e - least : e] == s[j : j + least] for o, s in shard for j in range(len(s)))]
        assert a.matches(text, least, below) == want


def test_packing():
    rng = np.random.default_rng(1)
    for n in (0, 1, 1000):
        v = np.sort(rng.integers(0, 2**64, n, dtype=np.uint64))
        assert (repeats.unpack(repeats.pack(v)) == v).all()
        x = rng.integers(-(2**62), 2**62, n)
        assert (repeats.unpack_loose(repeats.pack_loose(x)) == x).all()


# 8: SentencePiece


def test_pieces_against_library(docs, empty):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    own = sentencepieces.Pieces(PIECES)
    rng = random.Random(12)
    marks = list("abcdefgh   ..,,▁éß漢😀\n\t'\"-019")
    texts = ["".join(rng.choice(marks) for _ in range(rng.randint(0, 90))) for _ in range(1500)] + [r[1] or "" for r in documents()] + ["    " * 40 + "x", "a" * 2000]
    for text, ids in zip(texts, lib.encode(texts, num_threads=1), strict=True):
        assert own.encode(text) == ids, repr(text[:80])
        assert own.decode(ids) == lib.decode(ids)
    for _ in range(300):
        ids = [rng.randrange(32_000) if rng.random() < 0.6 else rng.randrange(3, 259) for _ in range(rng.randint(0, 30))]
        assert own.decode(ids) == lib.decode(ids)
    want = []
    for i, text in ((r[0], r[1] or "") for r in documents()):
        ids = lib.encode(text)
        want.append((str(i), len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256(lib.decode(ids).encode()).hexdigest()))
    got = [(str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in sentencepieces.digests(docs, PIECES).collect()]
    assert sorted(got) == sorted(want)
    full = [(str(r.doc_id), r.n_tokens, sha256(",".join(map(str, r.ids)).encode()).hexdigest(), r.decoded_sha256) for r in sentencepieces.encoded(docs, PIECES).collect()]
    assert sorted(full) == sorted(want)
    assert sentencepieces.digests(empty, PIECES).count() == sentencepieces.encoded(empty, PIECES).count() == 0


# 9: languages


def test_languages(spark, docs, empty):
    vocab = {"xx": "lorem ipsum dolor sit amet".split(), "yy": "quick brown fox jumps over".split(), "zz": "über straße können möchte wäre".split()}
    rng = random.Random(13)
    rows = [(i, " ".join(rng.choice(vocab[k]) for _ in range(rng.randint(5, 60))), k) for i in range(300) for k in [rng.choice(list(vocab))]]
    table = spark.createDataFrame([*rows, (900, None, "xx"), (901, "lorem ipsum dolor", None), (None, "123 456", "yy"), (902, "12 !?", None)], "doc_id long, text string, lang string")
    model = languages.train(table)
    assert model.langs == ["xx", "yy", "zz"]
    got = {r.doc_id: r for r in languages.identify(table, model).collect()}
    held = [(i, k) for i, _, k in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 30 and all(got[i].lang_pred == k for i, k in held)
    assert got[900].lang_pred == "und" and got[902].lang_pred == "und" and got[None].lang_pred == "und" and got[901].lang_pred == "xx"
    assert all(0 <= r.score <= 1 for r in got.values())
    both = " ".join(vocab["xx"] * 40 + vocab["zz"] * 20)
    found, share = model.infer(both.encode())
    assert [k for k, _ in found] == ["xx", "zz"] and 0.5 < share < 0.85
    assert languages.train(empty).langs == [] and languages.identify(empty, languages.train(empty)).count() == 0
    assert languages.identify(docs, model).count() == len(documents())


def test_mixtures_against_brute_force():
    """Shares by plain expectation-maximisation, and the best of all sets of languages."""
    rng = np.random.default_rng(17)
    counts = rng.integers(0, 60, (4, languages.FEATURES)) * (rng.random((4, languages.FEATURES)) < 0.3)
    model = languages.Model(["a", "b", "c", "d"], counts)
    texts = [bytes(rng.integers(97, 123, n).astype(np.uint8).tolist()) for n in (3, 40, 400)] + ["Füße, straße".encode() * 9]
    for text in texts:
        padded = [b for b in b" " + bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in text) + b" "]
        grams = Counter(tuple(padded[i : i + 3]) for i in range(len(padded) - 2))
        n = Counter()
        for (x, y, z), k in grams.items():
            if (x, y, z) != (32, 32, 32):
                n[((x << 16 | y << 8 | z) * 0x9E3779B1 % 2**32) >> 17] += k

        def fit(use):
            share = [1 / len(use)] * len(use)
            for _ in range(languages.STEPS if len(use) > 1 else 0):
                new = [0.0] * len(use)
                for f, k in n.items():
                    whole = sum(s * model.p[i, f] for s, i in zip(share, use, strict=True))
                    for j, i in enumerate(use):
                        new[j] += k * share[j] * model.p[i, f] / whole
                share = [x / sum(n.values()) for x in new]
            return share, sum(k * np.log(sum(s * model.p[i, f] for s, i in zip(share, use, strict=True))) for f, k in n.items())

        order = sorted(range(4), key=lambda i: -fit([0, 1, 2, 3])[0][i])
        cost = languages.PENALTY / 2 * np.log(max(2, sum(n.values())))
        sets = [sorted(order[:k]) for k in range(1, 5)]
        best = max(sets, key=lambda use: fit(use)[1] - (len(use) - 1) * cost)
        share = dict(zip((model.langs[i] for i in best), fit(best)[0], strict=True))
        found, top = model.infer(text)
        assert dict(found) == pytest.approx(share, abs=1e-9) and top == pytest.approx(max(share.values()))
        if best == sets[0]:  # no other single language does better than the one with the largest share of all
            assert fit(best)[1] >= max(fit([i])[1] for i in range(4)) - cost


def test_language_counts_leave_the_fold_out(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert languages.train(spark.createDataFrame([(i, "abc def", "xx") for i in ids], "doc_id long, text string, lang string")).langs == []
