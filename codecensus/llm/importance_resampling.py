"""Importance resampling towards a target text.

Features are runs of words, hashed into buckets. A bucket's gain is the
scaled log ratio of its share in the target and in the documents, a
document's weight the mean gain of its features. Documents are drawn without
repeats by their weight plus Gumbel noise that depends on the id alone
(top-k of perturbed weights), so a draw is the same wherever it runs.

Buckets come from CRC-32 values of all features of a piece of text at once
(``crc_spans``). Counts of the buckets are the only thing that reaches the
driver: one row a bucket. Ranks need no common task: rows are dealt by
ranges of their order and numbered inside a range; the ranges' sizes are
added up.

Defined cases: a null or empty text has no features and weight 0; a null
``doc_id`` draws as an empty id and stands before other ids in a tie; rows
that share an id each give a row (equal rows get different ranks); texts of
any length are read whole, in pieces; an empty target gives every bucket the
target count 0; empty documents give no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codecensus.llm.byte_words import LETTERS_DIGITS, Piece, pieces
from codecensus.llm.common import body, read, stored
from codecensus.llm.crc_spans import span_crcs

BUCKETS, LONGEST_RUN, LEAST_WORDS, DRAWN_PERCENT, SEED = 10_000, 1, 20, 10, "2024"


def run_spans(piece: Piece, longest: int):
    """Bytes, then starts, lengths and rows of all runs of 1 to ``longest``
    words (joined by one space) of each row that end in the piece's own part."""
    owner, lengths = piece.owner, piece.stops - piece.starts
    n = len(owner)
    if longest == 1:
        return piece.data, piece.starts, lengths, owner
    begin = np.cumsum(lengths + 1) - lengths - 1
    data = np.full(int((lengths + 1).sum()), ord(" "), np.uint8)
    inner = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    data[np.repeat(begin, lengths) + inner] = piece.data[np.repeat(piece.starts, lengths) + inner]
    starts, sizes, rows = [], [], []
    for r in range(1, longest + 1):
        i = np.arange(max(0, n - r + 1))
        i = i[(owner[i] == owner[i + r - 1]) & ((i + r > piece.repeated) | (owner[i] != piece.first))]
        starts.append(begin[i])
        sizes.append(begin[i + r - 1] + lengths[i + r - 1] - begin[i])
        rows.append(owner[i])
    return data, np.concatenate(starts), np.concatenate(sizes), np.concatenate(rows)


def feature_buckets(column: pa.Array, buckets: int, longest: int):
    """Bucket and row of every feature, piece by piece; and the rows' words."""
    for piece in pieces(column, LETTERS_DIGITS, back=longest - 1):
        data, starts, lengths, rows = run_spans(piece, longest)
        words = np.bincount(piece.owner[piece.repeated:], minlength=len(column))
        yield (span_crcs(data, starts, lengths) % np.uint32(buckets)).astype(np.int64), rows, words


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST_RUN) -> np.ndarray:
    """Number of features in each bucket over all texts: each task sends one
    row a bucket, the sums are as many."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for found, _, _ in feature_buckets(batch.column("text"), buckets, longest):
                total += np.bincount(found, minlength=buckets)
        have = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(have), pa.array(total[have])], names=["bucket", "n"])

    counts = np.zeros(buckets, np.int64)
    rows = texts.select(body().alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    for r in rows.collect():  # one row a bucket at most
        counts[r.bucket] = r.n
    return counts


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    all_source, all_target, n = float(source.sum()), float(target.sum()), float(len(source))
    return np.array([math.floor(1000 * math.log((t + 1) * (all_source + n) / ((s + 1) * (all_target + n))))
                     for s, t in zip(source.astype(float), target.astype(float), strict=True)], np.int64)


def weights(docs: DataFrame, gains: np.ndarray, longest: int = LONGEST_RUN) -> DataFrame:
    """doc_id, n_words, n_features and weight of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(gains)  # one number a bucket

    def run(batches):
        gain = sent.value
        for batch in batches:
            n, words = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            total = np.zeros(batch.num_rows)  # whole numbers, exact in doubles up to 2**53
            for found, rows, own in feature_buckets(batch.column("text"), len(gain), longest):
                n += np.bincount(rows, minlength=batch.num_rows)
                total += np.bincount(rows, gain[found], minlength=batch.num_rows)
                words += own
            weight = total.astype(np.int64) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words), pa.array(n), pa.array(weight)],
                                             names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), body().alias("text")).mapInArrow(
        run, "doc_id long, n_words long, n_features long, weight long")


def gumbel(seed: str) -> Column:
    """Scaled Gumbel noise of a row's id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h.cast("double") + 0.5) / F.lit(4294967296.0)))).cast("long")


def drawn(scored: DataFrame, least_words: int, percent: int) -> DataFrame:
    """Adds ``rank``: the places of the ``percent`` of all documents of
    enough words that have the highest scores, null for the others."""
    spark = scored.sparkSession
    order = [F.desc("eligible"), F.desc("score"), F.asc_nulls_first("doc_id")]
    dealt = (stored(scored.withColumn("eligible", F.col("n_words") >= least_words), "importance-scores")
             .repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order)
             .sortWithinPartitions(*order)
             .withColumn("at", F.monotonically_increasing_id()))
    # the id holds the partition above bit 33 and the place in it below
    dealt = stored(dealt.withColumns({"lane": F.shiftright("at", 33), "place": F.col("at").bitwiseAND((1 << 33) - 1)}),
                   "importance-order")
    before = Window.orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    lanes = (dealt.groupBy("lane").agg(F.count(F.lit(1)).alias("n"), F.count_if("eligible").alias("n_eligible"))
             .withColumns({"ahead": F.coalesce(F.sum("n").over(before), F.lit(0)),
                           "all_eligible": F.sum("n_eligible").over(Window.partitionBy())})
             .select("lane", "ahead", F.expr(f"{percent} * all_eligible div 100").alias("draw")))
    rank = F.col("ahead") + F.col("place") + 1
    return (dealt.join(F.broadcast(lanes), "lane")  # one row a shuffle partition
            .withColumn("rank", F.when(F.col("eligible") & (rank <= F.col("draw")), rank))
            .drop("lane", "at", "place", "ahead", "draw", "eligible"))


def importance_resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST_RUN,
                        least_words: int = LEAST_WORDS, percent: int = DRAWN_PERCENT, seed: str = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every document."""
    gains = bucket_gains(bucket_counts(docs, buckets, longest), bucket_counts(target, buckets, longest))
    scored = weights(docs, gains, longest).withColumn("score", F.col("weight") + gumbel(seed))
    return drawn(scored, least_words, percent)


def op12_importance_resampling(spark, sf_dir: str) -> DataFrame:
    return importance_resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_features", "weight", "score", "rank")


OP12_SQL = r"""
WITH RECURSIVE crc_table AS (
    SELECT list(c ORDER BY b) AS tab FROM (
        SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
        FROM (SELECT unnest(range(256)) AS b))
), doc_words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w,
           row_number() OVER () AS row_no
    FROM documents
), target_words AS (
    SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
    FROM benchmark
), long_words AS (SELECT row_no, doc_id, unnest(w) AS word FROM doc_words
), vocabulary AS (
    SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, [('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT
                                              for i in range(octet_length(encode(word)))]),
                                 lambda c, b: xor(c >> 8, tab[1 + xor(c, b) % 256])), 4294967295::BIGINT) % 10000 AS bucket
    FROM (SELECT DISTINCT word FROM (SELECT word FROM long_words UNION ALL SELECT word FROM target_words)), crc_table
), s AS (SELECT bucket, count(*) AS s FROM long_words JOIN vocabulary USING (word) GROUP BY bucket
), t AS (SELECT bucket, count(*) AS t FROM target_words JOIN vocabulary USING (word) GROUP BY bucket
), gains AS (
    SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)::DOUBLE
                                   / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain
    FROM s LEFT JOIN t USING (bucket)
), weighed AS (
    SELECT row_no, sum(gain)::BIGINT AS total FROM long_words JOIN vocabulary USING (word) JOIN gains USING (bucket) GROUP BY row_no
), scored AS (
    SELECT doc_id, len(w)::BIGINT AS n_features,
           CASE WHEN len(w) = 0 THEN 0 ELSE (total - ((total % len(w)) + len(w)) % len(w)) // len(w) END::BIGINT AS weight,
           floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE)
                                / 4294967296::DOUBLE)))::BIGINT AS noise
    FROM doc_words LEFT JOIN weighed USING (row_no)
), placed AS (
    SELECT *, weight + noise AS score,
           row_number() OVER (PARTITION BY n_features >= 20 ORDER BY weight + noise DESC, doc_id NULLS FIRST) AS place,
           (count(*) FILTER (n_features >= 20) OVER ()) * 10 // 100 AS draw
    FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= draw THEN place END AS rank FROM placed
"""
