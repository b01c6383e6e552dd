"""The queries that apply the operators of this subpackage to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import jaccard, langid, lm, media, mixing, packing, pii, suffixes, tokens, topk
from quillon.llm.common import read_table, whole_text


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of all vectors for every fiftieth."""
    return topk.top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP1 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
           FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id,
             CAST(list_sum(list_transform(list_zip(q.e, d.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v d ON q.vec_id % 50 = 0 AND d.vec_id <> q.vec_id AND len(q.e) = len(d.e)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return tokens.count_tokens(read_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens."""
    return packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.digest(read_table(spark, sf_dir, "documents"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stupid-backoff trigram scores of every document against all others."""
    return lm.score_corpus(read_table(spark, sf_dir, "documents"), 3)


OP5 = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT r, len(w) AS m, unnest(range(1, len(w) + 1)) AS i, w FROM d),
x AS (SELECT r, m, i, w[i] AS c, CASE WHEN i > 1 THEN w[i - 1] END AS b, CASE WHEN i > 2 THEN w[i - 2] END AS a FROM t),
o1 AS (SELECT r, c, count(*) AS f FROM x GROUP BY ALL), g1 AS (SELECT c, sum(f) AS f FROM o1 GROUP BY ALL),
o2 AS (SELECT r, b, c, count(*) AS f FROM x WHERE i > 1 GROUP BY ALL), g2 AS (SELECT b, c, sum(f) AS f FROM o2 GROUP BY ALL),
o3 AS (SELECT r, a, b, c, count(*) AS f FROM x WHERE i > 2 GROUP BY ALL), g3 AS (SELECT a, b, c, sum(f) AS f FROM o3 GROUP BY ALL),
e1 AS (SELECT r, c, CAST(round_even(ln(greatest(g1.f - o1.f, 1)) * 1000000, 0) AS BIGINT) AS log FROM o1 JOIN g1 USING (c)),
e2 AS (SELECT r, b, c, g2.f - o2.f AS f, CAST(round_even(ln(greatest(g2.f - o2.f, 1)) * 1000000, 0) AS BIGINT) AS log FROM o2 JOIN g2 USING (b, c)),
e3 AS (SELECT r, a, b, c, g3.f - o3.f AS f, CAST(round_even(ln(greatest(g3.f - o3.f, 1)) * 1000000, 0) AS BIGINT) AS log FROM o3 JOIN g3 USING (a, b, c)),
k AS (SELECT CAST(round_even(ln(0.4) * 1000000, 0) AS BIGINT) AS alpha, (SELECT count(*) FROM x) AS n),
s AS (SELECT x.r, sum(CASE WHEN abc.f > 0 THEN abc.log - ab.log
                           WHEN bc.f > 0 THEN bc.log - eb.log + (least(i, 3) - 2) * alpha
                           ELSE ec.log - CAST(round_even(ln(greatest(n - m, 1)) * 1000000, 0) AS BIGINT) + (least(i, 3) - 1) * alpha END) AS s
      FROM x CROSS JOIN k JOIN e1 ec ON ec.r = x.r AND ec.c = x.c
             LEFT JOIN e1 eb ON eb.r = x.r AND eb.c = x.b
             LEFT JOIN e2 bc ON bc.r = x.r AND bc.b = x.b AND bc.c = x.c
             LEFT JOIN e2 ab ON ab.r = x.r AND ab.b = x.a AND ab.c = x.b
             LEFT JOIN e3 abc ON abc.r = x.r AND abc.a = x.a AND abc.b = x.b AND abc.c = x.c GROUP BY x.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(s, 0) AS BIGINT) AS log_score,
       CASE WHEN len(w) > 0 THEN CAST(floor(CAST(s AS DOUBLE) / len(w)) AS BIGINT) END AS mean_log
FROM d LEFT JOIN s USING (r)
"""


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that aren't held out."""
    docs = read_table(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text"), langid.fit(docs))
    return found.select(F.col("doc_id").cast("long"), langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed to their sources' targets."""
    return mixing.mix(read_table(spark, sf_dir, "documents")).drop("source")


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents linked at 90 % of their three-word shingles."""
    return jaccard.jaccard_components(read_table(spark, sf_dir, "documents"), 3, 90)


OP8 = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
                                          WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(node, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON r.reached = e.a),
c AS (SELECT node, min(reached) AS component_id FROM r GROUP BY 1)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id FROM documents LEFT JOIN n USING (doc_id) JOIN c ON c.node = doc_id
"""


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes of repeated 400-byte strings."""
    return suffixes.dedup(read_table(spark, sf_dir, "documents")).drop("kept")


def op10_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an MPEG stream, read back."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", whole_text())
    stored = media.encode_column(docs.withColumn("n_bytes", F.octet_length("text").cast("long")))
    return media.digest_columns(stored)


QUERIES = {
    "op1_top_k": op1_top_k,
    "op2_token_counts": op2_token_counts,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_pii": op4_pii,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_language_id": op6_language_id,
    "op7_mixing": op7_mixing,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_mpeg_audio": op10_mpeg_audio,
}
ORACLES: dict[str, str] = {
    "op1_top_k": OP1,
    "op5_lm_scoring": OP5,
    "op8_ngram_jaccard_join": OP8,
}
