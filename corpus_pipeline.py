"""The corpus pipeline: from ``documents`` to encoded, cleaned text.

Five stages, each over all that its predecessor kept:

1. quality classifier: documents of too high perplexity go;
2. exact dedup: of equal texts the row with the largest id stays;
3. MinHash near-dedup: of each group the document with the smallest id stays;
4. benchmark decontamination: documents that hold a test item go;
5. BPE encoding and decoding: token counts and digests of what is left.

A stage's decisions are joined back by id and a hash of the text, so rows
that share an id are told apart; the join's narrow side is small or dealt by
the planner. Every stage but the last returns the columns of ``documents``;
a stage's result is written as Parquet and read again by the next one.

Defined cases: a null text is an empty text; empty texts pass the first
stage and one of them stays; rows with a null id are kept by the second and
third stage unless an equal or near text with an id is there; repeated rows
(same id, same text) become one in the second stage; empty tables give no
rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codecensus.llm.bpe_codec import codec_digests, default_tokenizer
from codecensus.llm.common import body, read, stored
from codecensus.llm.decontamination import contaminated
from codecensus.llm.exact_dedup import exact_dedup
from codecensus.llm.near_dedup import near_groups, words_key
from codecensus.llm.quality import mark, quality


def _matching(docs: DataFrame, own: F.Column, rows: DataFrame, how: str) -> DataFrame:
    """``docs`` that are (not) among ``rows`` (doc_id, mark), where ``own``
    is a document's mark."""
    columns = docs.columns
    stem = "_" * (1 + max(len(c) - len(c.lstrip("_")) for c in columns))  # names that no column has
    id_, of, mark_ = f"{stem}id", f"{stem}of", f"{stem}mark"
    marked = rows.select(F.col("doc_id").alias(id_), F.col("mark").alias(of)).distinct()
    return (docs.withColumn(mark_, own)
            .join(marked, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(mark_) == F.col(of)), how)
            .select(*columns))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rejected = quality(docs, read(spark, sf_dir, "labels")).filter("NOT kept")
    return _matching(docs, mark(), rejected, "left_anti")


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    stay = exact_dedup(docs).filter("kept OR keep_id IS NULL").select("doc_id", F.col("text_sha256").alias("mark"))
    return _matching(docs, F.sha2(body(), 256), stay, "left_semi").dropDuplicates(["doc_id", "text"])


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    stay = near_groups(docs).filter("class_id IS NULL OR doc_id = class_id").select("doc_id", F.col("key").alias("mark"))
    return _matching(docs, words_key(body()), stay, "left_semi")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    leaked = contaminated(docs, read(spark, sf_dir, "benchmark")).select("doc_id", F.col("text_crc32").alias("mark"))
    return _matching(docs, F.crc32(body()), leaked, "left_anti")


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return codec_digests(docs, default_tokenizer())


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("bpe_codec", encoding_stage),
]

#: No SQL expresses the model, the signatures, the alignment or the
#: automaton. The stages' operators are each tested against a plain version;
#: a test of run() as a whole against brute force is still to be written.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
