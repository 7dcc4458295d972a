"""The queries of the operators in this package, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.llm import ann, exact_dedup, html_extraction, jaccard_join, language_id, mixing, sentence_pieces, sharding, substring_dedup, suffix_dedup


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_graph_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mix(_documents(spark, sf_dir)).taken()


def op3_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_rows(_documents(spark, sf_dir), shards=24)
    return out.withColumn("law", F.lit("rows")).withColumn("grown_shard", F.lit(None).cast("int"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(_documents(spark, sf_dir))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(_documents(spark, sf_dir)).drop("kept")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_documents(spark, sf_dir))


def op8_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text", F.coalesce(F.length("text"), F.lit(0)).alias("n_chars"))
    return sentence_pieces.encode(docs, keep=["doc_id", "n_chars"]).select("doc_id", "n_chars", "n_tokens", "pieces", "round_trip")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(_documents(spark, sf_dir)).drop("kept")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_documents(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_graph_ann": op1_graph_ann,
        "op2_mix_sources": op2_mix_sources,
        "op3_ring_sharding": op3_ring_sharding,
        "op4_language_id": op4_language_id,
        "op5_html_extraction": op5_html_extraction,
        "op6_suffix_dedup": op6_suffix_dedup,
        "op7_exact_dedup": op7_exact_dedup,
        "op8_sentence_pieces": op8_sentence_pieces,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_jaccard_join": op10_jaccard_join,
        "pipeline": pipeline,
    }


_OP7 = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


_OP6 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
win AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM d WHERE n >= 50)),
least AS (SELECT s, min(doc_id) AS f FROM win GROUP BY s HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT doc_id, i FROM win JOIN least USING (s) WHERE f < doc_id),
isle AS (SELECT doc_id, i, sum(g) OVER (PARTITION BY doc_id ORDER BY i) AS k
         FROM (SELECT doc_id, i, coalesce((i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50)::INTEGER, 1) AS g FROM hit)),
span AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM isle GROUP BY doc_id, k),
gap AS (SELECT d.doc_id, coalesce(lag(b) OVER w, 0) AS lo, a AS hi, a, b FROM d JOIN span ON span.doc_id = d.doc_id WINDOW w AS (PARTITION BY d.doc_id ORDER BY a)),
kept AS (SELECT gap.doc_id, string_agg(substr(h, 2 * lo + 1, 2 * (hi - lo)), '' ORDER BY lo) || any_value(substr(h, 2 * top.b + 1)) AS t,
         sum(gap.b - gap.a)::BIGINT AS removed, count(*) AS spans
         FROM gap JOIN d ON d.doc_id = gap.doc_id JOIN (SELECT doc_id, max(b) AS b FROM span GROUP BY doc_id) top ON top.doc_id = gap.doc_id GROUP BY gap.doc_id)
SELECT d.doc_id, n AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(t, h))) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

_OP9 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS s
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
least AS (SELECT s, min(doc_id) AS d FROM win GROUP BY s HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT doc_id, i FROM win JOIN least USING (s) WHERE d < doc_id),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM hit)),
word AS (SELECT doc_id, p, ws[p] AS x FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM w)),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(g.n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g ON g.doc_id = w.doc_id
"""

_OP10 = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))
                               WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w)),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM pair JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y WHERE 100 * k >= 90 * (p.n + q.n - k)),
two AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
reach AS (SELECT x AS v, x AS c FROM two UNION SELECT b.y, r.c FROM reach r JOIN two b ON b.x = r.v)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce((SELECT min(c) FROM reach WHERE v = w.doc_id), w.doc_id) AS component_id
FROM w LEFT JOIN size ON size.doc_id = w.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_suffix_dedup": _OP6, "op7_exact_dedup": _OP7, "op9_substring_dedup": _OP9, "op10_jaccard_join": _OP10}
