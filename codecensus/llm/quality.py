"""Quality by the perplexity of an n-gram model of trusted text.

The model is an interpolated modified Kneser-Ney model of order two over
white-space words. Words outside the ``VOCABULARY`` most frequent ones of the
trusted text stand as unknown words, told apart by their shape (capitals,
letters only, trailing sentence mark, other signs). It is trained on the
trusted documents, less a part of them that is held out for the thresholds;
its counts are made over all of that text.

The probability of a word is taken apart into terms that can be looked up on
their own:

    ln p(w|v) = ln p(w) + ln backoff(v) + gain(v, w)

where the gain of a pair that was never seen is 0. The first two are tables
over the vocabulary. The gains are a table that grows with the text: the
``HOT`` most frequent pairs are sent to every task, which keeps them from
making hot shards, and the others are cut into shards by key. A document's
other pairs go to these shards, are counted against them there, and the sums
come back together per document. A shard's table is bounded; its documents
are dealt over as many tasks as they need, each with a copy of the table,
and stream past it.

A document is rejected if its mean negative log probability is above its
language's threshold: the ``QUANTILE`` of the held-out trusted documents of
that language, plus ``MARGIN`` times their distance from the median.

Result per document: doc_id, mark (a hash of the row), lang, n_tokens,
perplexity, threshold (a perplexity), kept.

Defined cases: null and empty texts have no words, perplexity null, and are
kept; a null language is a language of its own; a language without held-out
trusted documents takes the threshold of all of them, and without any the
documents are kept; a null ``doc_id`` is scored like any other and is never
trusted; a document that is labelled twice is trusted if all labels say so;
repeated rows each give a row; texts of any length are scored whole; empty
tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codecensus.llm.common import body, lists, mix, read, stored

VOCABULARY = 60_000  # words; with the shapes they fit 16 bits, a pair 32
HOT = 400_000  # pairs that every task holds
SHARD_PAIRS, LEAST_SHARDS = 1_000_000, 8  # pairs of the model that one shard should hold
BROADCAST_IDS = 4_000_000  # trusted ids that may be broadcast; more are joined by a shuffle
HELD_OUT = 4  # one trusted document in so many sets the thresholds
QUANTILE, MARGIN = 0.995, 0.25
SHARD_ROWS = 200_000  # rows of documents that a task of a shard should read
SLICE = 150_000
CACHED_WORDS = 200_000  # bounds a task's memory
#: Kinds of unknown words, told by the first pattern that fits; the last is for all others.
SHAPES = [re.compile(p) for p in (
    r"[^\W\d_]+", r"[^\W\d_]+[.,;:!?]", r"\d+", r"\w+", r"[^\w\s]+", r".*\w[^\w\s]{2,}")]


def shape(word: str) -> int:
    """Two kinds for each pattern: with and without a capital beyond the first letter."""
    kind = next((k for k, p in enumerate(SHAPES) if p.fullmatch(word)), len(SHAPES))
    return 2 * kind + (word[1:] != word[1:].lower())


KINDS = 2 * (len(SHAPES) + 1)


def mark() -> F.Column:
    """Tells apart documents that share an id."""
    return F.xxhash64(body(), F.col("lang").cast("string"))


class Model:
    """Tables over word numbers. Unknown words take the numbers from
    ``len(words)`` on, by shape."""

    def __init__(self, words: list[str]):
        self.words = {w: i for i, w in enumerate(words)}
        self.size = len(words) + KINDS

    def number(self, word: str, cache: dict[str, int]) -> int:
        n = self.words.get(word)
        if n is None:
            n = len(self.words) + shape(word)
        if len(cache) >= CACHED_WORDS:
            cache.clear()
        cache[word] = n
        return n

    def numbers(self, texts: list[str], cache: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of the texts, one after the other, and the offsets."""
        get, flat, ends = cache.get, [], [0]
        for text in texts:
            found = text.split()
            own = list(map(get, found))
            if None in own:
                own = [self.number(w, cache) if n is None else n for n, w in zip(own, found, strict=True)]
            flat += own
            ends.append(len(flat))
        return np.array(flat, np.int64), np.array(ends, np.int64)

    def train(self, seen: np.ndarray, by_first: dict[str, np.ndarray], kinds: np.ndarray) -> None:
        """``seen``: in how many different pairs a number comes second;
        ``by_first``: total, n1, n2, n3 of the pairs by their first number;
        ``kinds``: pairs that occur once, twice, three and four times."""
        self.discount = discounts(kinds)
        lower = discounts(np.array([(seen == k).sum() for k in (1, 2, 3, 4)]))
        total = max(1.0, seen.sum())
        cut = np.where(seen > 0, lower[np.minimum(seen, 3).astype(int)], 0.0)
        self.p = np.maximum(seen - cut, 0) / total + (cut.sum() / total if seen.sum() else 1.0) / self.size
        d = self.discount
        mass = d[1] * by_first["n1"] + d[2] * by_first["n2"] + d[3] * by_first["n3"]
        self.total = by_first["total"]
        self.backoff = np.where(self.total > 0, mass / np.maximum(self.total, 1), 1.0)
        self.ln_p, self.ln_backoff = np.log(self.p), np.log(np.maximum(self.backoff, 1e-300))

    def gain(self, key: np.ndarray, times: np.ndarray) -> np.ndarray:
        v, w = key // self.size, key % self.size
        own = (times - self.discount[np.minimum(times, 3)]) / self.total[v]
        return np.log(own + self.backoff[v] * self.p[w]) - self.ln_backoff[v] - self.ln_p[w]


def discounts(n: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts [0, D1, D2, D3+] from counts of counts;
    where these are too few to tell, 0.5, 0.75 and 0.9."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if not (n1 and n2 and n3 and n4):
        return np.array([0.0, 0.5, 0.75, 0.9])
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return np.array([0.0, *(min(max(d, 0.05), k - 0.05) for k, d in enumerate(found, 1))])


def pairs(numbers: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of neighbouring words inside each list, and the list indices."""
    if len(numbers) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    same = owner[1:] == owner[:-1]
    return (numbers[:-1] * size + numbers[1:])[same], owner[1:][same]


def _parts(batch: pa.RecordBatch):
    """Stretches of a batch of about SLICE words, as (from, to, texts)."""
    at, size, texts = 0, 0, []
    for k, x in enumerate(batch.column("text")):
        texts.append(x.as_py())
        size += len(texts[-1])
        if size >= 6 * SLICE:
            yield at, k + 1, texts
            at, size, texts = k + 1, 0, []
    if texts:
        yield at, at + len(texts), texts


def trusted_ids(labels: DataFrame) -> DataFrame:
    """(doc_id, held): all ids whose labels say quality 1; ``held`` ones set
    the thresholds and don't train."""
    return (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
            .filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
            .filter("quality = 1").select("doc_id", (F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(HELD_OUT)) == 0).alias("held")))


def train(docs: DataFrame, trusted: DataFrame, vocabulary: int = VOCABULARY, hot: int = HOT):
    """The model, its hot pairs (keys, gains), and the table of the others
    (key, gain)."""
    spark = docs.sparkSession
    ids = stored(trusted.filter("NOT held").select("doc_id"), "trusted")
    few = ids.count() <= BROADCAST_IDS
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body().alias("text"))
    text = text.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").select("text")

    def words(batches):
        for batch in batches:
            n = Counter()
            for x in batch.column("text"):
                n.update(x.as_py().split())
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())],
                                             names=["w", "n"])

    counted = text.mapInArrow(words, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))
    top = counted.filter("n > 1").orderBy(F.desc("n"), "w").limit(vocabulary)
    model = Model(top.select("w").toArrow().column("w").to_pylist())
    if model.size**2 > 2**32:
        raise ValueError("the vocabulary is too large for 32-bit pairs")
    sent = spark.sparkContext.broadcast(model)

    def count(batches):
        held, cache = sent.value, {}
        for batch in batches:
            found = [np.unique(pairs(*held.numbers(texts, cache), held.size)[0], return_counts=True) for _, _, texts in _parts(batch)]
            key, at = np.unique(np.concatenate([k for k, _ in found]) if found else np.zeros(0, np.int64), return_inverse=True)
            n = np.bincount(at, np.concatenate([c for _, c in found]), len(key)).astype(np.int64) if found else key
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["key", "n"])

    table = stored(text.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "pairs")
    size = model.size
    first, second = F.expr(f"key div {size}"), F.col("key") % size
    one = lambda k: F.sum((F.col("n") == k).cast("long"))
    kinds = table.agg(*(F.coalesce(one(k), F.lit(0)).alias(f"n{k}") for k in (1, 2, 3, 4))).first()
    by_first = {k: np.zeros(size) for k in ("total", "n1", "n2", "n3")}
    rows = table.groupBy(first.alias("v")).agg(  # a row per vocabulary number
        F.sum("n").alias("total"), one(1).alias("n1"), one(2).alias("n2"),
        F.sum((F.col("n") > 2).cast("long")).alias("n3")).toArrow()
    for k, v in by_first.items():
        v[rows.column("v").to_numpy()] = rows.column(k).to_numpy()
    seen = np.zeros(size)
    rows = table.groupBy(second.alias("w")).agg(F.count(F.lit(1)).alias("n")).toArrow()
    seen[rows.column("w").to_numpy()] = rows.column("n").to_numpy()
    model.train(seen, by_first, np.array(kinds))
    trained = spark.sparkContext.broadcast(model)

    def gains(batches):
        for batch in batches:
            key, n = batch.column("key").to_numpy(), batch.column("n").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(trained.value.gain(key, n).astype(np.float32))],
                                             names=["key", "gain"])

    hottest = table.orderBy(F.desc("n"), "key").limit(hot)
    hot_rows = hottest.mapInArrow(gains, "key long, gain float").toArrow()  # HOT rows at most
    order = np.argsort(hot_rows.column("key").to_numpy())
    hot_pairs = (hot_rows.column("key").to_numpy()[order], hot_rows.column("gain").to_numpy()[order])
    all_gains = table.mapInArrow(gains, "key long, gain float")
    return model, hot_pairs, all_gains, table.count()


def packed(key: np.ndarray) -> np.ndarray:
    """Keys of pairs in 32 bits; they stay different, their order does not matter."""
    return key.astype(np.uint32).view(np.int32)


def shard_of(key: np.ndarray, shards: int) -> np.ndarray:
    return (mix(key.view(np.uint64)) % np.uint64(shards)).astype(np.int32)


PART = "doc_id long, mark long, lang string, shard int, rank int, keys array<int>, values array<float>, n long, ln double"
SUM = "doc_id long, mark long, lang string, n long, ln double"


def perplexities(docs: DataFrame, model: Model, hot: tuple[np.ndarray, np.ndarray], gains: DataFrame,
                 model_pairs: int) -> DataFrame:
    """doc_id, lang, n_tokens, nll (mean negative ln p; null without words)
    of every row."""
    spark = docs.sparkSession
    shards = max(LEAST_SHARDS, -(-model_pairs // SHARD_PAIRS))
    copies = max(1, -(-docs.count() // SHARD_ROWS))  # a document has a row for each shard at most
    sent, known = spark.sparkContext.broadcast(model), spark.sparkContext.broadcast(hot)

    def parts(batches):
        """Per document a row with what the tables here give, and a row for
        each shard that its other pairs belong to."""
        held, (hot_key, hot_gain), cache = sent.value, known.value, {}
        for batch in batches:
            for a, b, texts in _parts(batch):
                n = b - a
                own, ends = held.numbers(texts, cache)
                owner = np.repeat(np.arange(n), np.diff(ends))
                ln = np.bincount(owner, held.ln_p[own], minlength=n)
                key, of = pairs(own, ends, held.size)
                ln += np.bincount(of, held.ln_backoff[key // held.size], minlength=n)
                if len(hot_key) and len(key):
                    at = np.minimum(np.searchsorted(hot_key, key), len(hot_key) - 1)
                    hit = hot_key[at] == key
                    ln += np.bincount(of[hit], hot_gain[at[hit]], minlength=n)
                    key, of = key[~hit], of[~hit]
                shard = shard_of(key, shards)
                order = np.lexsort((shard, of))
                key, of, shard = key[order], of[order], shard[order]
                new = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (shard[1:] != shard[:-1]))) if len(key) else np.zeros(0, np.int64)
                ids, marks, langs = (batch.column(c)[a:b] for c in ("doc_id", "mark", "lang"))
                mark = marks.to_numpy(zero_copy_only=False)
                m, total = len(new), n + len(new)
                pick = pa.array(np.concatenate([np.arange(n), of[new]]))
                edges = np.concatenate([np.zeros(n, np.int64), new, [len(key)]]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    ids.take(pick), marks.take(pick), langs.take(pick),
                    pa.array(np.concatenate([shard_of(mark, shards), shard[new]]), pa.int32()),
                    pa.array(np.ones(total, np.int32)),
                    pa.ListArray.from_arrays(pa.array(edges), pa.array(packed(key))),
                    pa.array([None] * total, pa.list_(pa.float32())),
                    pa.array(np.concatenate([np.diff(ends), np.zeros(m, np.int64)])),
                    pa.array(np.concatenate([ln, np.zeros(m)]))], names=[x.split()[0] for x in PART.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
                       mark().alias("mark"), body().alias("text"))
    looked = rows.mapInArrow(parts, PART)
    hot_key = known.value[0]

    def segments(batches):
        """Rows of the model, by shard; what is hot needs no place there."""
        for batch in batches:
            key, gain = batch.column("key").to_numpy(), batch.column("gain").to_numpy()
            if len(hot_key):
                held = known.value[0]  # in order
                keep = held[np.minimum(np.searchsorted(held, key), len(held) - 1)] != key
                key, gain = key[keep], gain[keep]
            shard = shard_of(key, shards)
            order = np.argsort(shard, kind="stable")
            key, gain, shard = key[order], gain[order], shard[order]
            cut = np.append(np.flatnonzero(np.append(True, shard[1:] != shard[:-1])), len(key)) if len(key) else [0]
            m = len(cut) - 1
            none = [None] * m
            at = pa.array(np.asarray(cut, np.int32))
            yield pa.RecordBatch.from_arrays([
                pa.array(none, pa.int64()), pa.array(none, pa.int64()), pa.array(none, pa.string()),
                pa.array(shard[np.asarray(cut[:-1], np.int64)], pa.int32()), pa.array(np.zeros(m, np.int32)),
                pa.ListArray.from_arrays(at, pa.array(packed(key))), pa.ListArray.from_arrays(at, pa.array(gain)),
                pa.array(none, pa.int64()), pa.array(none, pa.float64())], names=[x.split()[0] for x in PART.split(", ")])

    copied = gains.mapInArrow(segments, PART).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    dealt = looked.withColumn("copy", F.pmod(F.xxhash64("mark"), F.lit(copies)).cast("int"))
    # the task's number itself: hashed numbers would share tasks
    met = (dealt.unionByName(copied).repartitionById(shards * copies, (F.col("shard") * copies + F.col("copy")).cast("int"))
           .drop("copy").sortWithinPartitions("shard", "rank"))

    def look_up(batches):
        """A shard's model rows come first; its documents stream past."""
        here, loading, key, gain = None, [], None, None
        for batch in batches:
            shard, rank = batch.column("shard").to_numpy(), batch.column("rank").to_numpy()
            cut = np.flatnonzero(np.append(True, (shard[1:] != shard[:-1]) | (rank[1:] != rank[:-1])))
            for a, b in zip(cut, np.append(cut[1:], len(shard)), strict=True):
                part = batch.slice(a, b - a)
                if shard[a] != here:
                    here, loading, key = shard[a], [], None
                flat, ends = lists(part.column("keys"))
                if rank[a] == 0:
                    loading.append((flat, lists(part.column("values"))[0]))
                    continue
                if key is None:
                    key = np.concatenate([x for x, _ in loading]) if loading else np.zeros(0, np.int64)
                    gain = np.concatenate([x for _, x in loading]) if loading else np.zeros(0, np.float32)
                    order = np.argsort(key)
                    key, gain, loading = key[order], gain[order], []
                ln = part.column("ln").to_numpy().copy()
                if len(key) and len(flat):
                    at = np.minimum(np.searchsorted(key, flat), len(key) - 1)
                    hit = np.flatnonzero(key[at] == flat)
                    of = np.searchsorted(ends, hit, side="right") - 1
                    ln += np.bincount(of, gain[at[hit]], minlength=len(ln))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("mark"), part.column("lang"),
                                                  part.column("n"), pa.array(ln)], names=[x.split()[0] for x in SUM.split(", ")])

    sums = met.mapInArrow(look_up, SUM).groupBy("doc_id", "mark", "lang").agg(F.sum("n").alias("n"), F.sum("ln").alias("ln"))
    # equal rows have met in one sum; their mean is that of each of them
    own = docs.select(F.col("doc_id").cast("long").alias("d"), mark().alias("m")).groupBy("d", "m").agg(
        F.count(F.lit(1)).alias("rows"))
    return (sums.join(own, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")))
            .withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows"))))
            .select("doc_id", "mark", "lang", (F.col("n") / F.col("rows")).cast("long").alias("n_tokens"),
                    F.when(F.col("n") > 0, -F.col("ln") / F.col("n")).alias("nll")))


def thresholds(scored: DataFrame, trusted: DataFrame, quantile: float, margin: float) -> DataFrame:
    """(lang, cut) from the held-out trusted documents; a row without
    ``known`` is that of all languages together."""
    base = scored.join(trusted.filter("held"), "doc_id", "left_semi").filter("nll IS NOT NULL")
    cut = F.percentile_approx("nll", F.array(F.lit(0.5), F.lit(quantile)), F.lit(20_000)).alias("q")
    return base.rollup("lang").agg(cut, F.grouping("lang").alias("all")).select(
        "lang", "all", (F.col("q")[1] + margin * (F.col("q")[1] - F.col("q")[0])).alias("cut"))


def quality(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN,
            vocabulary: int = VOCABULARY, hot: int = HOT) -> DataFrame:
    trusted = stored(trusted_ids(labels), "trusted-ids")
    model, hot_pairs, gains, size = train(docs, trusted, vocabulary, hot)
    scored = stored(perplexities(docs, model, hot_pairs, gains, size), "perplexities")
    cuts = stored(thresholds(scored, trusted, quantile, margin), "thresholds")
    by_lang = cuts.filter("all = 0").select(F.col("lang").alias("l"), "cut")
    whole = cuts.filter("all = 1").select(F.col("cut").alias("whole"))  # one row
    limit = F.coalesce("cut", "whole")
    return (scored.join(by_lang, F.col("lang").eqNullSafe(F.col("l")), "left").join(F.broadcast(whole), F.lit(True), "left")
            .select("doc_id", "mark", "lang", "n_tokens", F.exp("nll").alias("perplexity"), F.exp(limit).alias("threshold"),
                    F.coalesce(F.col("nll") <= limit, F.lit(True)).alias("kept")))


def op6_quality(spark, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).drop("mark")
