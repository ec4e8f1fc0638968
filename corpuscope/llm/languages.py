"""Language ID by multilingual mixture inference.

A document is a mixture of languages: each of its n-grams comes from one language's n-gram distribution.
Expectation-maximisation estimates the proportions; among sets of languages the one with the best penalised likelihood
is kept, and the prediction is the set's language with the largest share.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.llm.common import lean, plus, small_batches, table

#: N-grams are three bytes of UTF-8 in lower case, hashed to so many features.
FEATURES = 1 << 15
#: A language's distribution is smoothed by so many occurrences of each feature.
SMOOTHING = 0.5
#: Each further language must raise the log-likelihood by so many times half the logarithm of the number of n-grams.
#: Overlapping n-grams are not independent, which is why this is well above 1.
PENALTY = 8.0
STEPS = 12
#: The model is languages * FEATURES numbers, held by the driver and sent to all tasks.
MOST_LANGUAGES = 400

_LETTER = regex.compile(r"\p{L}")
#: ASCII capitals become small letters; other ASCII but letters becomes a space.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def features(text: bytes) -> np.ndarray:
    """Counts of hashed trigrams of the whole text with a space on both ends; trigrams of three spaces, as between
    numbers, do not count."""
    b = np.frombuffer(b" " + text.translate(_PLAIN) + b" ", np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(FEATURES, np.int64)
    gram = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
    return np.bincount((gram[gram != 0x202020] * np.uint32(0x9E3779B1)) >> np.uint32(17), minlength=FEATURES)


class Model:
    """Log-likelihoods of n-grams under each language, from counts."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        smooth = counts + SMOOTHING
        self.p = smooth / smooth.sum(axis=1, keepdims=True)

    def _mixture(self, use: list[int], feats: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
        """Shares of the languages in ``use`` by expectation-maximisation, and the log-likelihood."""
        p, share = self.p[np.ix_(use, feats)], np.full(len(use), 1 / len(use))
        total = n.sum()
        if len(use) > 1:
            for _ in range(STEPS):
                share = share * (p @ (n / (share @ p))) / total
        return share, float(n @ np.log(share @ p))

    def infer(self, text: bytes) -> tuple[list[tuple[str, float]], float]:
        """The chosen languages with shares, largest first, and the prediction's share. Ties go to the language that
        sorts first."""
        counts = features(text)
        feats = np.flatnonzero(counts)
        if not len(feats) or not self.langs:
            return [], 0.0
        n = counts[feats].astype(float)
        everything = list(range(len(self.langs)))
        share, top = self._mixture(everything, feats, n)
        order = sorted(everything, key=lambda i: (-share[i], i))
        cost = PENALTY * 0.5 * math.log(max(2.0, n.sum()))
        best = None
        for k in range(1, len(order) + 1):
            # no set of k languages is likelier than all together
            if best is not None and top - (k - 1) * cost <= best[0]:
                break
            use = sorted(order[:k])
            got, likelihood = self._mixture(use, feats, n)
            if best is None or likelihood - (k - 1) * cost > best[0]:
                best = (likelihood - (k - 1) * cost, use, got)
        _, use, got = best
        found = sorted(((self.langs[i], float(s)) for i, s in zip(use, got, strict=True)), key=lambda x: (-x[1], x[0]))
        return found, min(1.0, found[0][1])


def fold() -> F.Column:
    """Remainder by 5 of the CRC-32 of the id as text; 0 is held out."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5


def train(docs: DataFrame) -> Model:
    """From all rows of ``docs`` with a language and outside the held-out fold. Counts are summed in each task first;
    the sums are one number per language and feature."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in lean(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if lang not in sums:
                    sums[lang] = np.zeros(FEATURES, np.int64)
                sums[lang] += features(text)
        for lang, x in sums.items():
            at = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(x[at])], names=["lang", "feature", "n"])

    small_batches(docs.sparkSession)
    learn = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.coalesce(fold(), F.lit(1)) != 0))
    counts = learn.select("lang", F.col("text").cast("binary")).mapInArrow(run, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    got = counts.groupBy("lang").agg(F.collect_list(F.struct("feature", "n")).alias("counts")).orderBy("lang").limit(MOST_LANGUAGES + 1).toLocalIterator()
    langs, rows = [], []
    for r in got:
        row = np.zeros(FEATURES)
        for feature, n in r.counts:
            row[feature] = n
        langs.append(r.lang)
        rows.append(row)
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    return Model(langs, np.array(rows).reshape(len(langs), FEATURES))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Adds ``lang_pred``, ``score`` and ``languages`` (array of language and share) to ``docs``, from ``text`` alone.

    The whole text counts. A null text and one without letters give ``und`` with score 0, as does a model of no
    languages. Other columns keep their values, but columns of the names added here are replaced.
    """
    docs = docs.drop("lang_pred", "score", "languages")
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast((model.langs, model.p.astype(np.float32)))
    kind = pa.list_(pa.struct([("language", pa.string()), ("share", pa.float64())]))

    def run(batches):
        langs, p = shared.value
        use = Model.__new__(Model)
        use.langs, use.p = langs, p.astype(float)
        for batch in lean(batches):
            pred, score, mix = [], [], []
            for text in batch.column("text").to_pylist():
                found, share = use.infer(text.encode()) if text and _LETTER.search(text) else ([], 0.0)
                pred.append(found[0][0] if found else "und")
                score.append(share)
                mix.append([{"language": a, "share": b} for a, b in found])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(mix, kind)], names=[*batch.schema.names, "lang_pred", "score", "languages"])

    schema = plus(docs.schema, "lang_pred string, score double, languages array<struct<language:string,share:double>>")
    return docs.mapInArrow(run, schema)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; the fold with remainder 0 is held out from learning."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs)
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (F.coalesce(fold(), F.lit(1)) == 0).alias("held_out"), "lang_pred", "score", F.concat_ws(",", F.col("languages.language")).alias("languages"))
