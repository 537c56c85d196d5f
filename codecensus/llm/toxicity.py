"""Toxicity by nearest labelled examples.

Texts are lower-cased words (letters and digits). A bounded sample of the
labelled rows (``EXAMPLES`` of each class, by the hash of the id) is split
into examples and calibration rows. Terms that tell the examples' classes
apart (log-likelihood ratio and odds) are the vocabulary; their document
frequencies are counted over all documents. An example is its TF-IDF vector
over the vocabulary; the vectors stand in an inverted index whose postings
are cut into blocks with the largest weight of each term in each block. A
text's exact nearest examples by cosine are found by taking blocks in the
order of their upper bounds until no bound beats the k-th best.

The neighbours vote, weighted by squared cosine, against a small prior; the
calibration rows, weighted to the classes' true shares, turn votes into
probabilities by isotonic regression. Scores look at nothing but the text.

Result per document: doc_id, score (0 to 1), and as evidence the nearest
examples (doc_id, toxic, similarity).

Defined cases: null and empty texts, and texts without a vocabulary term,
have no neighbours and get the calibrated score of no votes; without labels
that score is 0; a document that is labelled twice counts as toxic if any of
its labels says so; rows without a label or an id don't teach; a null
``doc_id`` is scored like any other; repeated rows each give a row; texts of
any length are read whole; of examples of the same similarity the smallest
``doc_id`` comes first; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codecensus.llm.common import body, lists, read
from codecensus.llm.decontamination import hashed_words

EXAMPLES = 6000  # labelled rows of each class that are looked at, at most
TERMS = 20_000  # vocabulary, at most
LEAST_DOCS, LEAST_G2, LEAST_ODDS = 3, 20.0, 4.0
NEIGHBOURS, BLOCK, PRIOR = 15, 64, 0.05
EVIDENCE = 3
SLICE = 400_000


class BlockMaxIndex:
    """Exact cosine top-k over sparse rows (example, term, weight)."""

    def __init__(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, rows: int, terms: int, block: int = BLOCK):
        norm = np.sqrt(np.bincount(row, weight**2, minlength=rows))
        weight = weight / norm[row]
        # rows with the same heaviest term share blocks, which keeps the bounds tight
        heavy = np.full(rows, -1)
        order = np.argsort(weight, kind="stable")
        heavy[row[order]] = term[order]
        self.order = np.argsort(heavy, kind="stable")
        place = np.empty(rows, np.int64)
        place[self.order] = np.arange(rows)
        at = place[row]
        order = np.lexsort((at, term))
        self.at, self.weight = at[order], weight[order]
        term = term[order]
        self.start = np.searchsorted(term, np.arange(terms + 1))
        self.block, self.blocks, self.rows = block, -(-rows // block), rows
        cell = term * self.blocks + self.at // block
        first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, np.int64)
        self.top = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0)
        self.top_block = (cell[first] % self.blocks) if len(first) else first
        self.top_start = np.searchsorted(term[first], np.arange(terms + 1))
        self.first = np.append(first, len(cell))

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest rows (index, cosine > 0), best first; ties by index."""
        weights = weights / np.sqrt((weights**2).sum())
        bound = np.zeros(self.blocks)
        entries = []  # block, posting range, query weight
        for t, w in zip(terms.tolist(), weights.tolist(), strict=True):
            a, b = self.top_start[t], self.top_start[t + 1]
            bound[self.top_block[a:b]] += w * self.top[a:b]
            entries.append((self.top_block[a:b], self.first[a:b + 1], w))
        todo = np.argsort(-bound, kind="stable")
        todo = todo[bound[todo] > 0]
        best_i, best_s = np.zeros(0, np.int64), np.zeros(0)
        step = 4
        for k0 in range(0, len(todo), step):
            if len(best_s) >= k and bound[todo[k0]] < best_s[k - 1] - 1e-12:
                break
            for b in todo[k0:k0 + step].tolist():
                score = np.zeros(self.block)
                for blocks, first, w in entries:
                    p = int(np.searchsorted(blocks, b))
                    if p < len(blocks) and blocks[p] == b:
                        s = slice(first[p], first[p + 1])
                        score[self.at[s] - b * self.block] += w * self.weight[s]
                some = np.flatnonzero(score > 0)
                best_i = np.append(best_i, self.order[b * self.block + some])
                best_s = np.append(best_s, score[some])
            keep = np.lexsort((best_i, -np.round(best_s, 12)))[:k]
            best_i, best_s = best_i[keep], best_s[keep]
        return best_i, best_s


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising steps (x, value) by pooling neighbours; each pool's mean is
    drawn towards the whole's by one row, so no step is quite 0 or 1."""
    order = np.argsort(x, kind="stable")
    x, y, w = x[order], y[order], w[order]
    edges, at = np.unique(x, return_index=True)
    total, mass = np.add.reduceat(y * w, at), np.add.reduceat(w, at)
    pools: list[list[float]] = []
    for e, t, m in zip(edges, total, mass, strict=True):
        pools.append([e, t, m])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            _, t2, m2 = pools.pop()
            pools[-1][1] += t2
            pools[-1][2] += m2
    mean, one = total.sum() / mass.sum(), mass.sum() / len(x)
    return np.array([p[0] for p in pools]), np.array([(p[1] + mean * one) / (p[2] + one) for p in pools])


class Model:
    def __init__(self, vocabulary: np.ndarray, idf: np.ndarray):
        self.vocabulary, self.idf = vocabulary, idf  # sorted word hashes and their weights
        self.index, self.ids, self.toxic = None, np.zeros(0, np.int64), np.zeros(0)
        self.steps, self.values = np.zeros(1), np.zeros(1)

    def vectors(self, flat: np.ndarray, offsets: np.ndarray):
        """(text, term, weight), sorted by text and term."""
        if not len(self.vocabulary) or not len(flat):
            return (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
        at = np.minimum(np.searchsorted(self.vocabulary, flat), len(self.vocabulary) - 1)
        hit = np.flatnonzero(self.vocabulary[at] == flat)
        owner = np.searchsorted(offsets, hit, side="right") - 1
        cell, times = np.unique(owner * len(self.vocabulary) + at[hit], return_counts=True)
        term = cell % len(self.vocabulary)
        return cell // len(self.vocabulary), term, (1 + np.log(times)) * self.idf[term]

    def votes(self, flat: np.ndarray, offsets: np.ndarray):
        """Vote of each text, and its neighbours."""
        n = len(offsets) - 1
        vote, near = np.zeros(n), [((), ())] * n
        if self.index is None:
            return vote, near
        row, term, weight = self.vectors(flat, offsets)
        ends = np.searchsorted(row, np.arange(n + 1))
        for i in np.flatnonzero(np.diff(ends)).tolist():
            s = slice(ends[i], ends[i + 1])
            found, cosine = self.index.nearest(term[s], weight[s], NEIGHBOURS)
            w = cosine**2
            vote[i] = (w * self.toxic[found]).sum() / (w.sum() + PRIOR)
            near[i] = (found[:EVIDENCE], cosine[:EVIDENCE])
        return vote, near

    def scores(self, vote: np.ndarray) -> np.ndarray:
        step = np.maximum(np.searchsorted(self.steps, vote + 1e-12, side="right") - 1, 0)
        return np.clip(self.values[step], 0.0, 1.0)


def _ranges(offsets: np.ndarray):
    at, n = 0, len(offsets) - 1
    while at < n:
        to = min(max(int(np.searchsorted(offsets, offsets[at] + SLICE, side="right")) - 1, at + 1), n)
        yield at, to
        at = to


def fit(docs: DataFrame, labels: DataFrame, learn: Column, examples: int = EXAMPLES) -> Model:
    """Train on the labelled rows whose ``doc_id`` fulfils ``learn``."""
    spark = docs.sparkSession
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
             .filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(learn)
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    share = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    part = None
    for toxic in (0, 1):  # a bounded number of ids
        own = known.filter(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples)
        part = own if part is None else part.unionByName(own)
    ids = spark.createDataFrame(part.toArrow())
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), hashed_words(body()).alias("hashes"))
    calibrates = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(3)) == 0
    sample = text.join(F.broadcast(ids), "doc_id").withColumn("calibrates", calibrates)

    terms = (sample.filter(~F.col("calibrates")).select("toxic", F.explode(F.array_distinct("hashes")).alias("h"))
             .groupBy("h").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")))
    sums = sample.filter(~F.col("calibrates")).groupBy().agg(F.sum("toxic").alias("T"), F.sum(1 - F.col("toxic")).alias("C")).first()
    model = Model(np.zeros(0, np.int64), np.zeros(0))
    if not sums["T"] or not sums["C"]:
        return model
    T, C = float(sums["T"]), float(sums["C"])
    n = F.col("t") + F.col("c")
    lr = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(F.lit(0.0))
    g2 = 2 * (lr(F.col("t"), n * (T / (T + C))) + lr(F.col("c"), n * (C / (T + C)))
              + lr(T - F.col("t"), (T + C - n) * (T / (T + C))) + lr(C - F.col("c"), (T + C - n) * (C / (T + C))))
    odds = (F.col("t") + 0.5) * (C - F.col("c") + 0.5) / ((F.col("c") + 0.5) * (T - F.col("t") + 0.5))
    chosen = (terms.filter(n >= LEAST_DOCS).withColumn("g2", g2).filter(F.col("g2") >= LEAST_G2)
              .filter((odds >= LEAST_ODDS) | (odds <= 1 / LEAST_ODDS)).orderBy(F.desc("g2"), "h").limit(TERMS))
    vocabulary = np.sort(np.array([r["h"] for r in chosen.select("h").collect()], np.int64))  # TERMS at most
    if not len(vocabulary):
        return model
    model = Model(vocabulary, np.ones(len(vocabulary)))
    sent = spark.sparkContext.broadcast(model)

    def frequencies(batches):
        seen, rows = np.zeros(len(vocabulary), np.int64), 0
        for batch in batches:
            flat, offsets = lists(batch.column("hashes"))
            rows += batch.num_rows
            for a, b in _ranges(offsets):
                _, term, _ = sent.value.vectors(flat[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                seen += np.bincount(term, minlength=len(vocabulary))
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(seen[some], rows))],
                                         names=["term", "n"])

    df, total = np.zeros(len(vocabulary)), 0
    counted = text.select("hashes").mapInArrow(frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    for r in counted.collect():  # a row per vocabulary term
        if r["term"] < 0:
            total = r["n"]
        else:
            df[r["term"]] = r["n"]
    model.idf = np.log((1 + total) / (1 + df)) + 1
    sent = spark.sparkContext.broadcast(model)

    def vectors(batches):
        for batch in batches:
            flat, offsets = lists(batch.column("hashes"))
            row, term, weight = sent.value.vectors(flat, offsets)
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("toxic"), batch.column("calibrates"),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(term)),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(weight))],
                names=["doc_id", "toxic", "calibrates", "terms", "weights"])

    rows = sample.mapInArrow(vectors, "doc_id long, toxic int, calibrates boolean, terms array<long>, weights array<double>")
    table = rows.toArrow().sort_by([("doc_id", "ascending")])  # the bounded sample, as sparse vectors
    train = table.filter(pa.compute.invert(table.column("calibrates"))).combine_chunks()
    check = table.filter(table.column("calibrates")).combine_chunks()
    term, ends = lists(train.column("terms"))
    weight, _ = lists(train.column("weights"))
    if not len(term):
        return model
    model.ids = train.column("doc_id").to_numpy()
    model.toxic = train.column("toxic").to_numpy().astype(float)
    row = np.repeat(np.arange(len(model.ids)), np.diff(ends))
    model.index = BlockMaxIndex(row, term.astype(np.int64), weight, len(model.ids), len(vocabulary))
    if check.num_rows:
        term, ends = lists(check.column("terms"))
        weight, _ = lists(check.column("weights"))
        vote = np.zeros(check.num_rows)
        for i in np.flatnonzero(np.diff(ends)).tolist():
            s = slice(ends[i], ends[i + 1])
            found, cosine = model.index.nearest(term[s].astype(np.int64), weight[s], NEIGHBOURS)
            vote[i] = (cosine**2 * model.toxic[found]).sum() / ((cosine**2).sum() + PRIOR)
        y = check.column("toxic").to_numpy().astype(float)
        held = {t: max(1, int((table.column("toxic").to_numpy() == t).sum())) for t in (0, 1)}
        w = np.where(y > 0, share.get(1, 0) / held[1], share.get(0, 0) / held[0])
        model.steps, model.values = isotonic(vote, y, w)
    else:  # too few rows to calibrate: the votes themselves
        model.steps = model.values = np.linspace(0, 1, 101)
    return model


SCORES = "doc_id long, score double, evidence array<struct<doc_id:long,toxic:int,similarity:double>>"


def score(docs: DataFrame, model: Model) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by EXAMPLES and TERMS
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("toxic", pa.int32()), ("similarity", pa.float64())]))

    def run(batches):
        held = sent.value
        for batch in batches:
            flat, offsets = lists(batch.column("hashes"))
            for a, b in _ranges(offsets):
                vote, near = held.votes(flat[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                evidence = [[{"doc_id": int(held.ids[j]), "toxic": int(held.toxic[j]), "similarity": float(c)}
                             for j, c in zip(*x, strict=True)] for x in near]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[a:b], pa.array(held.scores(vote)), pa.array(evidence, kind)],
                    names=["doc_id", "score", "evidence"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), hashed_words(body()).alias("hashes")).mapInArrow(run, SCORES)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % 3 == 1


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit(docs, read(spark, sf_dir, "labels"), ~held_out())
    return score(docs, model).select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"), "evidence")
