"""Near-duplicates by ProbMinHash, banding and verification.

A document is its five-word shingles, each weighted 1 + ln(times it occurs).
Every shingle is a Poisson process whose rate is its weight: its arrivals
fall on the components of the signature at random, and a component keeps the
shingle that arrives first. Two signatures agree in a component with the
probability Jaccard similarity of the weighted sets. Arrivals are drawn round
by round for the shingles of a block of documents together; a shingle whose
next arrival is later than all of its document's components is done. Links
are judged by the plain sets, so a document that repeats shingles has a second
signature, of equal weights; for any other document the two are the same.

Documents of the same words form one class; its representative stands for
it. Representatives that agree in a band are neighbours; neighbours of
neighbours form a candidate component, which goes to one task together with
its texts. There all pairs that matter are verified: two representatives are
linked if the Jaccard similarity of their shingle sets is 0.8 or more, and a
search from text to text over the links finds the groups, comparing a text
only with those that no group has yet.

A candidate component of more words than a task should hold is dealt over
blocks. Its most connected members go into every block, and afterwards every
member outside the largest group found is compared with all blocks, so no
link is lost.

Result per document: ``class_id``, the smallest ``doc_id`` of its group,
``class_size`` (documents in the group) and ``n_texts`` (different word
sequences in it).

Defined cases: a null text is an empty text; all texts without words form
one class; a text of under five words is one shingle; a null ``doc_id``
never names a class unless all of the class are null; repeated rows each
count; texts of any length are compared whole; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codecensus.llm.common import as_list, body, grams, lists, mix, read, stored, word_hashes, words
from codecensus.llm.components import components

SHINGLE, BANDS, ROWS, SIMILARITY = 5, 32, 6, 0.8
SLICE = 400_000  # words whose arrivals are drawn together
BLOCK = 1_000_000  # words of a candidate component that one task holds
CENTRES = 32  # members of a large component that every block sees


def _slices(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of lists of about ``most`` values each."""
    out, at, n = [], 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        to = min(max(to, at + 1), n)
        out.append((at, to))
        at = to
    return out


def shingle_sets(flat: np.ndarray, offsets: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each list: hash, list index (sorted), times."""
    h, owner, _ = grams(flat, offsets, n)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(first)
    return h[at], owner[at], np.diff(np.append(at, len(h)))


def prob_minhash(h: np.ndarray, owner: np.ndarray, weight: np.ndarray, docs: int, m: int) -> np.ndarray:
    """Signatures [docs, m]: of each component, the element that arrives
    first. Documents without elements get zeros."""
    first, sig = np.full(docs * m, np.inf), np.zeros(docs * m, np.uint64)
    time = np.zeros(len(h))
    turn = 0
    while len(h):
        turn += 1
        bits = mix(h + np.uint64((turn * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
        uniform = ((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        time = time - np.log(uniform) / weight
        component = ((mix(bits ^ np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        cell = owner * m + component.astype(np.int64)
        np.minimum.at(first, cell, time)
        won = first[cell] == time
        sig[cell[won]] = h[won]
        latest = first.reshape(docs, m).max(axis=1)
        on = time < latest[owner]
        h, owner, weight, time = h[on], owner[on], weight[on], time[on]
    return sig.reshape(docs, m)


def bands(sig: np.ndarray, rows: int) -> np.ndarray:
    docs, m = sig.shape
    parts = sig.reshape(docs, m // rows, rows)
    h = np.broadcast_to(np.arange(1, m // rows + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(rows):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return h.view(np.int64)


def words_key(text: F.Column) -> F.Column:
    """Names a text's words."""
    return F.unhex(F.md5(F.array_join(words(text), " ")))


def signatures(docs: DataFrame, shingle: int = SHINGLE, n_bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, key, n_words, bands) of each row; ``key`` names its words;
    ``bands`` has those of both signatures where a shingle is repeated."""
    text = body()
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_key(text).alias("key"),
                       word_hashes(text).alias("hashes"))

    def run(batches):
        for batch in batches:
            flat, offsets = lists(batch.column("hashes"))
            for a, b in _slices(offsets, SLICE):
                part = offsets[a:b + 1] - offsets[a]
                h, owner, times = shingle_sets(flat[offsets[a]:offsets[b]], part, shingle)
                found = bands(prob_minhash(h, owner, 1.0 + np.log(times), b - a, n_bands * rows), rows)
                twice = np.unique(owner[times > 1])
                own = np.isin(owner, twice)
                plain = bands(prob_minhash(h[own], np.searchsorted(twice, owner[own]), np.ones(int(own.sum())), len(twice), n_bands * rows), rows)
                both = np.concatenate([found, plain])
                whose = np.concatenate([np.arange(b - a), twice])
                order = np.argsort(whose, kind="stable")
                order = order[np.diff(part)[whose[order]] > 0]
                found = both[order].reshape(-1)
                ends = np.concatenate([[0], np.cumsum(np.bincount(whose[order], minlength=b - a) * n_bands)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[a:b], batch.column("key")[a:b], pa.array(np.diff(part), pa.int64()),
                     as_list(found, ends)], names=["doc_id", "key", "n_words", "bands"])

    return base.mapInArrow(run, "doc_id long, key binary, n_words long, bands array<long>")


def link_groups(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Group label (an index) of each set of distinct hashes, under links of
    Jaccard ``similarity`` or more. Exact: a set is compared with every set
    that has no group yet when it is its turn."""
    n = len(sets)
    label = np.arange(n)
    if n < 2:
        return label
    sizes = np.array([len(s) for s in sets])
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    mark = np.zeros(int(codes.max()) + 1 if len(codes) else 1, np.int32)
    left = np.flatnonzero(sizes)  # sets without a group
    flat, starts = codes, ends[:-1][left]
    held = len(left)
    grouped = np.zeros(n, bool)
    for seed in range(n):
        if grouped[seed] or not sizes[seed]:
            continue
        grouped[seed] = True
        queue = [seed]
        while queue:
            x = queue.pop()
            own = codes[ends[x]:ends[x + 1]]
            left_on = ~grouped[left]
            if not left_on.any():
                break
            if left_on.sum() * 2 < held:  # fewer are left: shorten what is scanned
                left = left[left_on]
                flat = np.concatenate([codes[ends[i]:ends[i + 1]] for i in left])
                starts = np.concatenate([[0], np.cumsum(sizes[left])[:-1]])
                held, left_on = len(left), np.ones(len(left), bool)
            mark[own] = 1
            both = np.add.reduceat(mark[flat], starts)
            mark[own] = 0
            hit = left[left_on & (both >= similarity * (len(own) + sizes[left] - both) - 1e-9)]
            grouped[hit] = True
            label[hit] = seed
            queue.extend(hit.tolist())
    return label


def _verify(cells: DataFrame, texts: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """Star edges (a, b) of the groups found in each cell. ``cells``: key,
    cell; ``texts``: key, hashes."""
    rows = texts.join(cells, "key").select("cell", "key", word_hashes(F.col("text")).alias("hashes"))
    dealt = rows.repartition("cell").sortWithinPartitions("cell", "key")

    def groups(batches):
        """(cell, keys, sets) of each run of equal cells."""
        cell, keys, sets = None, [], []
        for batch in batches:
            flat, offsets = lists(batch.column("hashes"))
            cells_, keys_ = batch.column("cell").to_pylist(), batch.column("key").to_pylist()
            for a, b in _slices(offsets, SLICE):
                h, owner, _ = shingle_sets(flat[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], shingle)
                ends = np.searchsorted(owner, np.arange(b - a + 1))
                for i in range(a, b):
                    if cells_[i] != cell:
                        if keys:
                            yield keys, sets
                        cell, keys, sets = cells_[i], [], []
                    if not keys or keys_[i] != keys[-1]:  # repeated rows stand next to each other
                        keys.append(keys_[i])
                        sets.append(h[ends[i - a]:ends[i - a + 1]].copy())
        if keys:
            yield keys, sets

    def run(batches):
        for keys, sets in groups(batches):
            label = link_groups(sets, similarity)
            at = np.flatnonzero(label != np.arange(len(keys)))
            if len(at):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([keys[i] for i in at], pa.binary()), pa.array([keys[label[i]] for i in at], pa.binary())],
                    names=["a", "b"])

    return dealt.mapInArrow(run, "a binary, b binary")


def _cell(*cols) -> F.Column:
    return F.md5(F.concat_ws("-", *cols))


def near_groups(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, n_bands: int = BANDS,
                rows: int = ROWS, block: int = BLOCK, centres: int = CENTRES) -> DataFrame:
    """doc_id, key (of its words), class_id, class_size, n_texts of every row."""
    signed = stored(signatures(docs, shingle, n_bands, rows), "signatures")
    classes = stored(signed.groupBy("key").agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.max("n_words").alias("n_words")), "classes")
    band = (signed.groupBy("key").agg(F.first("bands").alias("bands"))
            .select("key", F.explode(F.array_distinct("bands")).alias("band")))
    shared = band.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("centre")).filter("n > 1")
    near = stored(band.join(shared, "band").groupBy("key", "centre").agg(F.sum("n").alias("n")), "neighbours")
    coarse = components(near.select(F.col("key").alias("a"), F.col("centre").alias("b")))
    known = near.groupBy("key").agg(F.sum("n").alias("degree"))
    member = stored(coarse.select(F.col("node").alias("key"), "label").join(known, "key")
                    .join(classes.select("key", "rep", "n_words"), "key"), "members")
    load = stored(member.groupBy("label").agg(F.sum(F.col("n_words") + 64).alias("load")).withColumn(
        "blocks", F.ceil(F.col("load") / block).cast("int")), "loads")

    # a representative's text, under the key of its words; the members grow with
    # the documents, so both sides are dealt out at every size
    every = docs.select(F.col("doc_id").cast("long").alias("rep"), body().alias("text"))
    texts = (every.join(member.select("key", "rep").hint("merge"), "rep").filter(words_key(F.col("text")) == F.col("key")).select("key", "text"))
    # classes without any id: one of their texts
    nameless = every.filter("rep IS NULL").select(words_key(F.col("text")).alias("key"), "text").groupBy("key").agg(F.min("text").alias("text"))
    texts = texts.unionByName(nameless.join(member.filter("rep IS NULL").select("key"), "key", "left_semi"))

    placed = member.join(load, "label").withColumn(
        "b", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).select("key", "label", "degree", "blocks", "b")
    large = placed.filter("blocks > 1")
    first = placed.select("key", _cell(F.hex("label"), F.lit("b"), "b").alias("cell"))
    if large.isEmpty():
        links = stored(_verify(first, texts, similarity, shingle), "links")
    else:
        large = stored(large, "large")
        rank = F.row_number().over(W.partitionBy("label").orderBy(F.desc("degree"), "key"))
        everywhere = large.withColumn("rank", rank).filter(F.col("rank") <= centres).select(
            "key", "label", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"))
        cells = first.unionByName(everywhere.select("key", _cell(F.hex("label"), F.lit("b"), "b").alias("cell"))).distinct()
        links = stored(_verify(cells, texts, similarity, shingle), "links")
        # whoever is not in the largest group of a large component meets all of its blocks
        found = components(links).select(F.col("node").alias("key"), F.col("label").alias("grp"))
        state = stored(large.join(found, "key", "left").withColumn("grp", F.coalesce("grp", "key")), "large-state")
        main = state.groupBy("label", "grp").agg(F.count(F.lit(1)).alias("n")).groupBy("label").agg(
            F.max(F.struct("n", "grp"))["grp"].alias("main"))
        split = state.join(main, "label")
        stray = split.filter("grp <> main").withColumn(
            "s", F.pmod(F.xxhash64("key", F.lit(1)), F.col("blocks")).cast("int"))
        chunk = stray.select("label", "s").distinct()
        sides = split.select("key", "label", "b").join(chunk, "label").unionByName(stray.select(
            "key", "label", "s", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b")))
        again = sides.select("key", _cell(F.hex("label"), F.lit("s"), "s", "b").alias("cell")).distinct()
        links = links.unionByName(stored(_verify(again, texts, similarity, shingle), "links"))
    groups = components(links).select(F.col("node").alias("key"), "label")
    named = stored(classes.join(groups, "key", "left").withColumn("label", F.coalesce("label", "key")), "named")
    totals = named.groupBy("label").agg(F.min("rep").alias("class_id"), F.sum("copies").alias("class_size"),
                                        F.count(F.lit(1)).alias("n_texts"))
    of = named.select("key", "label").join(totals, "label").select("key", "class_id", "class_size", "n_texts")
    return signed.select("doc_id", "key").join(of, "key").select("doc_id", "key", "class_id", "class_size", "n_texts")


def op10_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_groups(read(spark, sf_dir, "documents")).drop("key")
