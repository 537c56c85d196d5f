"""Benchmark decontamination: gram seeds and Smith-Waterman alignment.

Texts are lower-cased words (letters and digits). Every three-word gram of a
test item is a seed, however common it is. A document that holds a seed is
aligned with the item around the seed's diagonal: the local alignment's score
(match 2, mismatch -1, gap -1), as a part of the score of the whole item,
tells copies, edited copies and paraphrases from chance hits. A copy in which
no three neighbouring words of the item stand together any more is not a leak.

The test items go to the tasks in blocks of bounded size; a test set beyond
the bound takes several blocks, each a pass over the documents. Documents
are never shuffled.

Result: one row per document and item that leaked: doc_id, text_crc32, item_id,
score, similarity (0 to 1), first_word and last_word (the aligned place in the
document, from 0).

Defined cases: null and empty texts and items match nothing; an item under
three words is its own only seed; a null ``doc_id`` or ``item_id`` is carried
along; repeated rows each count; empty tables give no rows; other columns are
ignored; documents of any length are read whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codecensus.llm.common import body, grams, lists, read

GRAM = 3
MATCH, MISMATCH, GAP = 2, -1, -1
LEAK = 0.4
BLOCK_BYTES = 8 << 20  # of test items that tasks hold at once
SLICE = 400_000  # words that are searched at once
CELLS = 4_000_000  # of the alignment tables that are filled together


def hashed_words(text: F.Column) -> F.Column:
    found = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(found, lambda w: F.xxhash64(w))


class Items:
    """Test items of one block, as arrays: words, grams and seeds."""

    def __init__(self, table: pa.Table, n: int):
        column = table.column("hashes").combine_chunks()
        flat, self.offsets = lists(column)
        self.words = flat.astype(np.int64)
        self.ids = table.column("item_id").to_pylist()
        self.n = n
        self.length = np.diff(self.offsets)
        self.gram, self.item, self.start = grams(self.words, self.offsets, n)
        self.sizes = sorted(set(np.minimum(self.length[self.item], n).tolist()))

    def seeds(self) -> "Seeds":
        return Seeds(self.gram, self.item, self.start, self.sizes)


class Seeds:
    def __init__(self, gram: np.ndarray, item: np.ndarray, start: np.ndarray, sizes: list[int]):
        order = np.argsort(gram, kind="stable")
        self.gram, self.item, self.start, self.sizes = gram[order], item[order], start[order], sizes

    def hits(self, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, item, diagonal) of every seed in the documents."""
        docs, items, diagonals = [], [], []
        for n in self.sizes:
            h, owner, at = grams(flat, offsets, n)
            lo, hi = np.searchsorted(self.gram, h), np.searchsorted(self.gram, h, side="right")
            some = np.flatnonzero(hi > lo)
            times = (hi - lo)[some]
            entry = np.repeat(lo[some], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            docs.append(np.repeat(owner[some], times))
            items.append(self.item[entry])
            diagonals.append(np.repeat(at[some], times) - self.start[entry])
        return np.concatenate(docs), np.concatenate(items), np.concatenate(diagonals)


def align(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local score of rows of ``a`` [pairs, m] against ``b`` [pairs, w],
    and the index in ``b`` where it ends first. Padding: -1 in a, -2 in b."""
    pairs, w = b.shape
    j = np.arange(w + 1, dtype=np.int32) * -GAP
    row = np.zeros((pairs, w + 1), np.int32)
    best, end = np.zeros(pairs, np.int32), np.zeros(pairs, np.int64)
    for i in range(a.shape[1]):
        x = a[:, i:i + 1]
        new = np.zeros_like(row)
        step = np.where(x == b, MATCH, MISMATCH).astype(np.int32)
        new[:, 1:] = np.maximum(row[:, :-1] + step, row[:, 1:] + GAP)
        np.maximum(new, 0, out=new)
        new += j
        np.maximum.accumulate(new, axis=1, out=new)
        new -= j
        np.maximum(new, 0, out=new)
        row = np.where(x == PAD, row, new) if (x == PAD).any() else new
        top = row.argmax(axis=1)
        score = row[np.arange(pairs), top]
        up = score > best
        best[up], end[up] = score[up], top[up] - 1
    return best, end


PAD = np.int64(-(2**63))  # no word hashes to it but by a chance of 2**-64


def _padded(flat: np.ndarray, start: np.ndarray, stop: np.ndarray, pad: int) -> np.ndarray:
    width = int((stop - start).max())
    at = start[:, None] + np.arange(width)
    inside = at < stop[:, None]
    return np.where(inside, flat[np.where(inside, at, 0)], pad)


def leaks(flat: np.ndarray, offsets: np.ndarray, items: Items, seeds: Seeds, least: float):
    """(document, item, score, first, last) of the leaks in the documents."""
    doc, item, diagonal = seeds.hits(flat, offsets)
    if not len(doc):
        return []
    length = items.length[item]
    slack = np.maximum(8, length // 2)
    lo = np.maximum(diagonal - slack, 0)
    hi = np.minimum(diagonal + length + slack, np.diff(offsets)[doc])
    order = np.lexsort((lo, item, doc))
    doc, item, lo, hi = doc[order], item[order], lo[order], hi[order]
    # windows that overlap belong to one place
    reach = pd.Series(hi).groupby([doc, item]).cummax().to_numpy()
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (lo[1:] > reach[:-1])
    at = np.flatnonzero(new)
    doc, item, lo = doc[at], item[at], lo[at]
    hi = np.maximum.reduceat(hi, at)
    width, m = hi - lo, items.length[item]
    order = np.lexsort((width, m))
    out, k = [], 0
    while k < len(order):
        to = k + 1
        cost = int(width[order[k]] + 1)
        while to < len(order) and (to + 1 - k) * max(cost, int(width[order[to]] + 1)) <= CELLS // 8:
            cost = max(cost, int(width[order[to]] + 1))
            to += 1
        own = order[k:to]
        k = to
        a = _padded(items.words, items.offsets[item[own]], items.offsets[item[own] + 1], PAD)
        b = _padded(flat, offsets[doc[own]] + lo[own], offsets[doc[own]] + hi[own], PAD + 1)
        score, end = align(a, b)
        own_best = MATCH * m[own]
        hit = np.flatnonzero(score >= least * own_best)
        if len(hit):  # the other end: align what was read, backwards
            o = own[hit]
            stop = end[hit] + 1
            back_b = _padded(flat[::-1], len(flat) - (offsets[doc[o]] + lo[o] + stop),
                             len(flat) - (offsets[doc[o]] + lo[o]), PAD + 1)
            back_a = _padded(items.words[::-1], len(items.words) - items.offsets[item[o] + 1],
                             len(items.words) - items.offsets[item[o]], PAD)
            _, back = align(back_a, back_b)
            out += zip(doc[o].tolist(), item[o].tolist(), score[hit].tolist(),
                       (lo[o] + stop - 1 - back).tolist(), (lo[o] + stop - 1).tolist(), strict=True)
    best: dict = {}
    for d, i, score, first, last in out:  # the best place of each document and item
        if (d, i) not in best or (score, -first) > (best[d, i][0], -best[d, i][1]):
            best[d, i] = (score, first, last)
    return [(d, i, *v) for (d, i), v in sorted(best.items())]


def _ranges(offsets: np.ndarray, most: int):
    at, n = 0, len(offsets) - 1
    while at < n:
        to = min(max(int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1, at + 1), n)
        yield at, to
        at = to


LEAKS = "doc_id long, text_crc32 long, item_id long, score long, similarity double, first_word long, last_word long"


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = LEAK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The leaks of all test items in all documents."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), body().alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    found = None
    for block in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        part = _block(docs, own.select("item_id", hashed_words(F.col("text")).alias("hashes")).toArrow(), least, spark)
        found = part if found is None else found.unionByName(part)
    return found


def _block(docs: DataFrame, table: pa.Table, least: float, spark) -> DataFrame:
    items = spark.sparkContext.broadcast(Items(table, GRAM))  # a block of bounded size
    hashes = hashed_words(body()).alias("hashes")

    seeds = spark.sparkContext.broadcast(items.value.seeds())

    def search(batches):
        held, own = items.value, seeds.value
        for batch in batches:
            flat, offsets = lists(batch.column("hashes"))
            ids, crcs = batch.column("doc_id"), batch.column("text_crc32")
            for a, b in _ranges(offsets, SLICE) if own.sizes else ():
                rows = leaks(flat[offsets[a]:offsets[b]].astype(np.int64), offsets[a:b + 1] - offsets[a], held, own, least)
                if rows:
                    d, i, score, first, last = (np.array(c) for c in zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(d + a)), crcs.take(pa.array(d + a)), pa.array([held.ids[k] for k in i], pa.int64()), pa.array(score),
                         pa.array(score / (MATCH * held.length[i])), pa.array(first), pa.array(last)],
                        names=["doc_id", "text_crc32", "item_id", "score", "similarity", "first_word", "last_word"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.crc32(body()).alias("text_crc32"), hashes).mapInArrow(
        search, LEAKS)


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
