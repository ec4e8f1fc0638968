"""Small tables with what real ones hold: nulls, empty and long texts, copies, ties, clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, shard string, fp string, copies string, rank string, score string, class string, ids string, bin string, src string"


def documents():
    rng = random.Random(5)
    words = ["al", "ber", "cor", "dan", "é", "fg", "HI", "jk,", "lm.", "naïve", "日本", "o", "pq", "rs", "tu"]
    text = lambda n: " ".join(rng.choice(words) + rng.choice(words) for _ in range(n))
    long = text(30_000)
    base = text(300).split(" ")
    near = [" ".join([*base[:k], "changed", *base[k + 1 :]]) for k in (20, 150, 280)]
    passage = text(60)
    rows = [
        (0, " ".join(base)), (1, near[0]), (2, near[1]), (3, near[2]), (4, " ".join(base)), (5, None), (6, ""), (7, " \t\n"), (8, long), (9, long[:-3]),
        (10, "one"), (11, "ONE"), (12, "two words"), (13, text(40) + " " + passage + " " + text(40)), (14, passage), (15, text(5) + "\n\n" + passage + "\r\n\x0b\x0c" + text(9)),
        (16, "a b c ▁ d  e"), (17, "x" * 5000), (18, "😀 <|endoftext|> </s> ▁▁ \x00 end"), (None, passage), (None, None), (19, "12345 !!! ???"), (20, passage), (20, passage), (-3, passage + " tail"),
    ]
    rows += [(100 + i, text(rng.choice([3, 12, 30, 80]))) for i in range(60)]
    langs, sources = ["en", "fr", None], ["a", "B", "é", None]
    return [(i, t, langs[k % 3], sources[k % 4], None if t is None else len(t), "x", "y", None, "1", "2", "3", "4", "5", "6", "7") for k, (i, t) in enumerate(rows)]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)


def words(text):
    return (text or "").encode().split()
