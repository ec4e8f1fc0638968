"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.llm.common import table
from corpuscope.llm.languages import op9_language
from corpuscope.llm.mixing import op4_entropy_mix
from corpuscope.llm.neighbours import op7_neighbours
from corpuscope.llm.pages import op6_pages
from corpuscope.llm.repeats import op5_repeats
from corpuscope.llm.resharding import op1_reshard
from corpuscope.llm.sentencepieces import op8_sentencepiece
from corpuscope.llm.simhash import op2_simhash
from corpuscope.llm.vector_copies import near_vectors, op10_vector_copies
from corpuscope.llm.wavelet import op3_wavelet

def _mix_round(k: int) -> str:
    """SQL of one round that makes good what a source's words lack, from the cells ``c{k}`` to ``c{k + 1}``."""
    return f"""
        l{k} AS (SELECT *, round(target) - sum(total * size) OVER (PARTITION BY src) AS lack FROM c{k}),
        m{k} AS (SELECT *, CASE WHEN size = 0 OR size > abs(lack) THEN 0 WHEN lack > 0 THEN 3 * n - total ELSE total END AS room FROM l{k}),
        c{k + 1} AS (SELECT src, size, n, target, total + sign(lack) * greatest(0, least(room, floor((abs(lack) - coalesce(sum(room * size) OVER
          (PARTITION BY src ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / greatest(size, 1)))) AS total FROM m{k}),"""


def _links_sql(vectors: str) -> str:
    """SQL of links, components and kept vectors over the rows of ``vectors`` (vec_id, e)."""
    return f"""
        WITH RECURSIVE v AS ({vectors}),
        ok AS (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
        r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
        n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
        c AS (SELECT a, min(b) AS c FROM r GROUP BY a)
        SELECT vec_id, coalesce(n.n, 0) AS n_links, c.c AS component_id, vec_id = c.c AS kept
        FROM v LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
    """


def vector_copies_turned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links among all vectors and slightly turned, scaled copies of them: the given vectors alone hold no pair at 0.95."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    turned = rows.select((F.col("vec_id") + 1_000_000).alias("vec_id"), F.expr("transform(embedding, (x, i) -> 2 * x + if(i = 0, 0.6D, 0D))").alias("embedding"))
    close = rows.select((F.col("vec_id") + 2_000_000).alias("vec_id"), F.expr("transform(embedding, (x, i) -> x + if(i = 1, 0.1D, 0D))").alias("embedding"))
    return near_vectors(rows.unionByName(turned).unionByName(close))


QUERIES = {
    "op1_reshard": op1_reshard,
    "op2_simhash": op2_simhash,
    "op3_wavelet": op3_wavelet,
    "op4_entropy_mix": op4_entropy_mix,
    "op5_repeats": op5_repeats,
    "op6_pages": op6_pages,
    "op7_neighbours": op7_neighbours,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_language": op9_language,
    "op10_vector_copies": op10_vector_copies,
    "vector_copies_turned": vector_copies_turned,
}

ORACLE_SQL: dict[str, str] = {
    "op4_entropy_mix": r"""
        WITH RECURSIVE d AS (SELECT doc_id, CASE WHEN source IS NULL THEN 'n' ELSE 'a' || source END AS src,
                   len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS size,
                   CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 4) AS INT) % 64 AS bin FROM documents),
        s0 AS (SELECT src, CAST(sum(size) AS BIGINT) AS words FROM d GROUP BY src),
        s1 AS (SELECT *, ([5.0, 2.0, 1.0]::DOUBLE[])[(row_number() OVER (ORDER BY src) - 1) % 3 + 1] AS weight, words * 3.0::DOUBLE AS cap FROM s0),
        s2 AS (SELECT *, cap / weight AS ratio, (sum(words) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
               FROM s1 WINDOW b AS (ORDER BY cap / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        t AS (SELECT src, words, coalesce(least(cap, (SELECT level FROM s2 WHERE level * weight <= cap ORDER BY ratio, src LIMIT 1) * weight), cap) AS target FROM s2),
        k AS (SELECT src, size, count(*) AS n FROM d GROUP BY src, size),
        z AS (SELECT src, sum(CAST(n AS DOUBLE) * size * size) / sum(n * size) AS scale FROM k GROUP BY src),
        h AS (SELECT src, 0 AS step, -1e5::DOUBLE AS lo, 1e5::DOUBLE AS hi FROM t WHERE words > 0
              UNION ALL
              SELECT src, step + 1, CASE WHEN got < target THEN (lo + hi) / 2 ELSE lo END, CASE WHEN got < target THEN hi ELSE (lo + hi) / 2 END
              FROM (SELECT h.src, step, lo, hi, t.target, sum(n * size * least(exp(least((lo + hi) / 2 * size / scale, 700)), 3)) AS got
                    FROM h JOIN k USING (src) JOIN z USING (src) JOIN t USING (src) WHERE step < 100 GROUP BY h.src, step, lo, hi, t.target)),
        x AS (SELECT src, (lo + hi) / 2 AS x FROM h WHERE step = 100),
        r AS (SELECT k.*, target, CAST(floor(1000000 * CASE WHEN size = 0 THEN 1 WHEN target >= words * 3 * (1 - 1e-12::DOUBLE) THEN 3 WHEN target <= 0 THEN 0
              ELSE least(exp(least(x * size / scale, 700)), 3) END + 0.5) AS BIGINT) AS rate
              FROM k JOIN t USING (src) LEFT JOIN x USING (src) LEFT JOIN z USING (src)),
        p AS (SELECT src, size, n, target, rate // 1000000 AS base, (sum(n * (rate % 1000000)) OVER (PARTITION BY src ORDER BY size DESC ROWS UNBOUNDED PRECEDING) + 500000) // 1000000 AS passed FROM r),
        c0 AS (SELECT src, size, n, target, base * n + least(n, passed - coalesce(lag(passed) OVER (PARTITION BY src ORDER BY size DESC), 0)) AS total FROM p),
    """
    + "".join(map(_mix_round, range(4)))
    + """
        b AS (SELECT src, size, bin, CAST(total AS BIGINT) // n AS base, CAST(total AS BIGINT) % n AS extra, n, k, CAST(sum(k) OVER (PARTITION BY src, size ORDER BY bin ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
              FROM (SELECT src, size, bin, count(*) AS k FROM d GROUP BY src, size, bin) JOIN c4 USING (src, size)),
        q AS (SELECT src, size, bin, base, (upto * extra) // n - ((upto - k) * extra) // n AS more FROM b)
        SELECT doc_id, CAST(size AS BIGINT) AS size, words AS source_size, target,
          CAST((base + CASE WHEN row_number() OVER (PARTITION BY src, size, bin ORDER BY doc_id) <= more THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
        FROM d JOIN q USING (src, size, bin) JOIN t USING (src)
    """,
    "op5_repeats": r"""
        WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
        g AS (SELECT doc_id, i, string_agg(word, ' ') OVER n13 AS t, count(*) OVER n13 AS n FROM p
              WINDOW n13 AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
        m AS (SELECT t, min(doc_id) AS first FROM g WHERE n = 13 GROUP BY t),
        hit AS (SELECT g.doc_id, g.i FROM g JOIN m USING (t) WHERE g.n = 13 AND m.first < g.doc_id),
        gone AS (SELECT DISTINCT doc_id, i + k AS i FROM hit, range(0, 13) r(k)),
        k AS (SELECT p.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p.i) AS t FROM p ANTI JOIN gone USING (doc_id, i) GROUP BY p.doc_id)
        SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
        FROM d LEFT JOIN k ON k.doc_id = d.doc_id
    """,
    "op10_vector_copies": _links_sql("SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings"),
    "vector_copies_turned": _links_sql("""
        SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
        UNION ALL SELECT 1000000 + vec_id, list_transform(embedding::DOUBLE[], lambda x, i: 2 * x + CASE WHEN i = 1 THEN 0.6 ELSE 0 END) FROM embeddings
        UNION ALL SELECT 2000000 + vec_id, list_transform(embedding::DOUBLE[], lambda x, i: x + CASE WHEN i = 2 THEN 0.1 ELSE 0 END) FROM embeddings"""),
}
