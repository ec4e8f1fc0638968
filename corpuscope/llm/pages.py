"""HTML extraction with a suffix array over each host's token streams.

A page falls into blocks of text. Markup says what it can: blocks inside an article (or, without one, the main element)
are the page's text, and those inside menus, headers, footers, sidebars, forms, adverts, notices and comments are not.
On the rest the host decides, whether the page has an article or not, with menus and the like as further witnesses: the token streams of its
pages outside articles are concatenated, a suffix array finds the long substrings that repeat in other pages, and
blocks which these cover go; runs that only their page has stay. A large host has a suffix array for each group of its
pages; hashes of windows tell each group what other groups of the host have too, so groups do not change the result
(but for equal 64-bit hashes of different windows).

Text inside an article is kept even where it repeats on other pages: articles do quote and republish each other, and
taking repeats away there would take the text itself.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from corpuscope.llm.common import kept, small_batches, table
from corpuscope.llm.near_texts import mixed

#: A repeated substring has at least so many tokens (a power of two).
REPEAT = 8
#: A block goes if at least this share of its tokens lies in repeated substrings.
COVERED = 0.5
#: A host's pages are dealt to groups of about so many bytes of text outside articles.
GROUP_BYTES = 2 << 20

# Element and attribute names of HTML, and usual names for parts of a page.
_RAW = frozenset("script style noscript template iframe svg math object canvas audio video textarea select title head".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_APART = frozenset("nav footer aside form menu dialog button search".split())
_NAMES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation sidebar breadcrumb breadcrumbs cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription share sharing social related recommended comment comments reply replies respond disqus footer login signup signin pagination pager skip masthead topbar toolbar copyright teaser teasers adsense adslot".split())
_MAIN_NAMES = frozenset("article content post entry story main article-body article-content post-body post-content entry-content story-body main-content".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar toolbar".split())

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|style|aria-hidden|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def _part(name: str, attributes: str) -> tuple[bool, bool, str]:
    """What an element is by its name and attributes: a part besides the text, a header, and the place it opens: ``article``,
    ``main`` or none."""
    apart, header, place = name in _APART, name == "header", name if name in ("article", "main") else ""
    for m in _ATTRIBUTE.finditer(attributes) if attributes else ():
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id"):
            words = re.split(r"[^a-z]+", value)
            apart, header = apart or not _NAMES.isdisjoint(words), header or "header" in words
            if not place and not _MAIN_NAMES.isdisjoint(value.split()):
                place = "main"
        elif key == "role":
            apart, place = apart or value in _ROLES, place or ("main" if value == "main" else "")
        elif key == "itemprop" and value == "articlebody":
            place = "article"
        elif key == "hidden" or (key == "style" and re.search(r"display\s*:\s*none", value)) or (key == "aria-hidden" and value == "true"):
            apart = True
    return apart, header, place


def blocks(page: str) -> list[tuple[str, str]]:
    """The page's blocks in order as (place, text): ``article``, ``main``, ``apart`` or ``open`` (nothing known).

    Character references are decoded, white space runs are one space, empty blocks are left out. Unclosed elements end
    with the one around them, an unfinished tag at the end is dropped.
    """
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, bool, str]] = []  # name, apart, place
    held: list[str] = []
    place, apart = "open", False

    def flush():
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            out.append(("apart" if apart else place, text))

    at, n = 0, len(page)
    while at < n:
        m = _MARKUP.search(page, at)
        end = m.start() if m else n
        if end > at:
            held.append(html.unescape(page[at:end]))
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if name == "br":
            held.append(" ")
        if m[1]:
            if name in _BLOCK or name in _APART:
                flush()
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
        elif not m[4]:
            break
        elif name in _RAW:
            if name != "head":
                close = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
                if not m[3].endswith("/") or name not in ("svg", "math"):
                    at = close.end() if close else n
        elif name in _BLOCK or name in _APART:
            flush()
            if name in _VOID:
                continue
            if name == "p":
                if stack and stack[-1][0] == "p":
                    stack.pop()
            elif name in ("body", "article", "main"):
                while stack and stack[-1][0] == "p":
                    stack.pop()
            besides, header, opens = _part(name, m[3])
            around = stack[-1][2] if stack else "open"
            inner = around if around == "article" or not opens else opens
            # a page's header is a part besides; that of an article or the main part has its title
            besides = besides or (header and inner == "open")
            stack.append((name, besides or (stack[-1][1] if stack else False), inner))
        else:
            continue
        apart, place = (stack[-1][1], stack[-1][2]) if stack else (False, "open")
    flush()
    return out


def repeated(tokens: np.ndarray, page: np.ndarray) -> np.ndarray:
    """Marks the tokens inside substrings of at least ``REPEAT`` tokens that occur in two pages or more.

    ``tokens`` are the pages' streams one after another. Suffixes are sorted by prefix doubling up to ``REPEAT``
    tokens; neighbours in the array with such a prefix in common form a group, and a group over several pages covers
    its prefixes. A longer repeat is covered by its windows.
    """
    n = len(tokens)
    covered = np.zeros(n, bool)
    if n < 2:
        return covered
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1
    length = 1
    while length < REPEAT:
        ahead = np.zeros(n, np.int64)
        ahead[:-length] = np.where(page[length:] == page[:-length], rank[length:], 0) if length < n else 0
        # a suffix that ends with its page before the prefix does equals no other
        ahead = np.where(ahead == 0, -np.arange(1, n + 1), ahead)
        order = np.lexsort((ahead, rank))
        new = np.ones(n, np.int64)
        new[1:] = (rank[order][1:] != rank[order][:-1]) | (ahead[order][1:] != ahead[order][:-1])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        length *= 2
    array = np.argsort(rank, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], rank[array][1:] != rank[array][:-1]]))
    owners = page[array]
    many = np.minimum.reduceat(owners, starts) != np.maximum.reduceat(owners, starts)
    begin = array[np.repeat(many, np.diff(np.append(starts, n)))]
    steps = np.zeros(n + REPEAT + 1, np.int64)
    np.add.at(steps, begin, 1)
    np.add.at(steps, begin + REPEAT, -1)
    return np.cumsum(steps)[:n] > 0


def window_keys(words: list[str], page: np.ndarray, host: str) -> tuple[np.ndarray, np.ndarray]:
    """Where windows of ``REPEAT`` tokens within a page begin, and their hashes, which differ from host to host."""
    n = len(words) - REPEAT + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = {w: xxh64_intdigest(w) for w in set(words)}
    h, salt = np.fromiter((hashes[w] for w in words), np.uint64, len(words)), np.full(n, xxh64_intdigest(host), np.uint64)
    for k in range(REPEAT):
        salt = mixed(salt ^ h[k : k + n], k)
    at = np.flatnonzero(page[:n] == page[REPEAT - 1 :])
    return at, salt[at].view(np.int64)


def _stream(pages_blocks: list) -> tuple[list[str], np.ndarray]:
    words, page = [], []
    for p, parts in enumerate(pages_blocks):
        for b in parts:
            w = b["text"].split()
            words += w
            page += [p] * len(w)
    return words, np.array(page, np.int64)


def shared_windows(large: DataFrame) -> DataFrame:
    """From ``host``, ``part`` and ``rest`` of hosts in several groups to the windows that several of them have: each once for each group."""

    def windows(batches):
        for batch in batches:
            by_group: dict[tuple[str, int], list] = {}
            for host, part, rest in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                by_group.setdefault((host, part), []).append(rest)
            for (host, part), rests in by_group.items():
                keys = np.unique(window_keys(*_stream(rests), host)[1])
                yield pa.RecordBatch.from_arrays([pa.array([host] * len(keys), pa.string()), pa.array(np.full(len(keys), part, np.int32)), pa.array(keys)], names=["host", "part", "window"])

    met = large.select("host", "part", "rest").mapInArrow(windows, "host string, part int, window long").repartition("host", "window").dropDuplicates()
    by = Window.partitionBy("host", "window")
    return met.select("*", F.min("part").over(by).alias("lo"), F.max("part").over(by).alias("hi")).where("lo <> hi").select("host", "part", "window")


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages`` (``page_id``, ``url``, ``html``): ``page_id``, ``url``, ``text``, ``n_chars``.

    The whole html counts; a null one, or one without text, gives an empty text. Without a url pages share one host.
    Repeated rows are pages of their own and bear witness against each other outside articles. Other columns are
    ignored; empty tables give no rows. Only text outside articles moves to its host, in groups of bounded size.
    """
    kept_blocks = pa.list_(pa.struct([("at", pa.int32()), ("text", pa.string())]))
    place = pa.list_(pa.struct([("at", pa.int32()), ("apart", pa.bool_()), ("text", pa.string())]))

    def parse(batches):
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 33
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                piece = batch.slice(k, 512)
                mine, sure, rest, uids = [], [], [], []
                for page in piece.column(2).to_pylist():
                    found = blocks(page or "")
                    wanted = next((w for w in ("article", "main") if any(x[0] == w for x in found)), None)
                    mine.append([{"at": i, "text": t} for i, (w, t) in enumerate(found) if w == wanted])
                    sure.append(all(w in (wanted, "apart") for w, _ in found))
                    rest.append([{"at": i, "apart": w == "apart", "text": t} for i, (w, t) in enumerate(found) if w != wanted])
                    uids.append(uid)
                    uid += 1
                yield pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), piece.column(0), piece.column(1), pa.array(mine, kept_blocks), pa.array(sure, pa.bool_()), pa.array(rest, place)], names=["uid", "page_id", "url", "mine", "sure", "rest"])

    small_batches(pages.sparkSession)
    schema = "uid long, page_id long, url string, mine array<struct<at:int,text:string>>, sure boolean, rest array<struct<at:int,apart:boolean,text:string>>"
    parsed, _ = kept(pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(parse, schema), "pages")

    outside = parsed.select("uid", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), _HOST, 1)).alias("host"), "rest").where(F.size("rest") > 0)
    weight = F.aggregate("rest", F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x["text"]))
    groups = outside.groupBy("host").agg(F.ceil(F.sum(weight) / GROUP_BYTES).cast("int").alias("groups"))
    dealt = outside.join(groups, "host").withColumn("part", F.pmod(F.xxhash64("uid"), F.col("groups")).cast("int"))

    def judge(group, shared):
        uids, rest = (group.column(c).to_pylist() for c in ("uid", "rest"))
        order = sorted(range(len(uids)), key=lambda i: uids[i])
        words, page = _stream([rest[i] for i in order])
        spans, end = [], 0
        for i in order:
            for b in rest[i]:
                begin, end = end, end + len(b["text"].split())
                spans.append((i, b, begin, end))
        covered = repeated(np.unique(np.array(words, dtype=object), return_inverse=True)[1] if words else np.zeros(0, np.int64), page)
        if shared.num_rows:
            at, keys = window_keys(words, page, group.column("host")[0].as_py())
            at = at[np.isin(keys, shared.column("window").to_numpy())]
            for k in range(REPEAT):
                covered[at + k] = True
        sums = np.concatenate([[0], np.cumsum(covered)])
        found: dict[int, list[dict]] = {}
        for i, b, begin, end in spans:
            if not b["apart"] and sums[end] - sums[begin] < COVERED * (end - begin):
                found.setdefault(uids[i], []).append({"at": b["at"], "text": b["text"]})
        return pa.table([pa.array(list(found), pa.int64()), pa.array(list(found.values()), kept_blocks)], names=["uid", "own"])

    shared = shared_windows(dealt.where("groups > 1"))
    own = dealt.groupBy("host", "part").cogroup(shared.groupBy("host", "part")).applyInArrow(judge, "uid long, own array<struct<at:int,text:string>>")
    text = lambda parts: F.array_join(F.transform(parts, lambda x: x["text"]), "\n\n").alias("text")
    certain = parsed.where("sure").select("page_id", "url", text("mine"))
    judged = parsed.where("NOT sure").join(own, "uid", "left").select("page_id", "url", text(F.array_sort(F.concat("mine", F.coalesce("own", F.slice("mine", 1, 0))))))
    return certain.unionByName(judged).withColumn("n_chars", F.char_length("text").cast("long"))


def op6_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages."""
    return extract(table(spark, sf_dir, "pages"))
