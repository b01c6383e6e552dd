"""The corpus pipeline: five stages over ``documents``, each by one operator.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but
the last return the columns of ``documents``. Each begins with small executor heaps, as those
that the stage before has grown would stand beside its own Python workers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import jaccard, langid, mixing, packing, pii
from quillon.llm.common import materialise, read_table, shrink_heaps
from quillon.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents whose language is less sure than this go, as do those with none.
LEAST_SCORE = 0.5
#: Near duplicates: five-word shingles, a similarity of 0.8 or more.
SHINGLE, PERCENT = 5, 80

#: SQL can express neither the classifier nor the packing; the stages are tested against
#: brute-force versions.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents in a language that is known with a score of ``LEAST_SCORE``; a
    null text, or one without a letter, goes."""
    shrink_heaps(spark)
    found = langid.identify(docs.select(COLUMNS), langid.fit(docs), lang="_found", score="_score")
    return found.filter((F.col("_found") != langid.UNKNOWN) & (F.col("_score") >= LEAST_SCORE)).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates, whatever their ids: of its smallest
    doc_id (null last). Documents without words have no duplicates, and stay."""
    shrink_heaps(spark)
    stays = jaccard.surviving_rows(docs, SHINGLE, PERCENT).withColumnsRenamed({"doc_id": "_kept", "tid": "_text"})
    empty = docs.select(COLUMNS).filter(mixing.size_of() == 0)
    worded = docs.select(*COLUMNS, F.unhex(F.md5("text")).alias("_tid")).filter(mixing.size_of() > 0)
    kept = worded.join(stays, F.col("doc_id").eqNullSafe(F.col("_kept")) & (F.col("_tid") == F.col("_text")), "left_semi")
    # rows that share an id and a text are one document
    one = kept.groupBy("doc_id", "_tid").agg(F.min(F.struct(COLUMNS)).alias("row")).select("row.*")
    return one.unionByName(empty)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind in brackets; all documents stay."""
    shrink_heaps(spark)
    found = pii.redact(pii.find(docs.select(COLUMNS), to="_pii"), spans="_pii").drop("_pii")
    return found.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix takes its first word."""
    shrink_heaps(spark)
    rows = docs.select(COLUMNS)
    mixed = mixing.mix(rows)
    # rows that share an id, source and size share their copies; one of each joins
    copies = mixed.groupBy("doc_id", "source", "size").agg(F.max("copies").alias("copies")).filter("copies > 0")
    x, y = rows.withColumn("_size", mixing.size_of()).alias("x"), copies.alias("y")
    joined = x.join(y, F.col("x.doc_id").eqNullSafe(F.col("y.doc_id")) & F.col("x.source").eqNullSafe(F.col("y.source")) & (F.col("x._size") == F.col("y.size")))
    return joined.select(*(F.col(f"x.{c}") for c in COLUMNS), F.explode(F.sequence(F.lit(1), F.col("y.copies").cast("int"))).alias("_copy")).drop("_copy")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces of sequences of 4096 tokens."""
    shrink_heaps(spark)
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", near_duplicates),
    ("pii", personal_data),
    ("mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
