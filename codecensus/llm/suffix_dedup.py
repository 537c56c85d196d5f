"""Suffix-array dedup: remove every byte that a repeated string covers.

A string of ``WIDTH`` bytes is repeated if it starts at two places or more,
in the same text or in any other; matches don't cross texts. All bytes of all
repeated strings go.

Equal strings have equal anchors: the anchor of a window of ``WIDTH`` bytes
is the least hash among its grams of ``k`` bytes. A text falls into segments,
the runs of windows with the same anchor, so each window is in one segment.
An anchor that has one place has no repeated window. Of the others, equal
segments are one (with a weight), and the different segments of an anchor
form a small text. Its suffix array, built by linear grouping
(:mod:`suffix_groups`), puts equal windows next to each other; their bytes
are compared, and runs of a weight of two or more are repeated.

An anchor with more than ``LIMIT`` different segments (a common phrase, in
other words) is cut anew with longer grams, and at last with grams of the
whole width, where the segments of an anchor are equal windows. So no task
holds an unbounded text and nothing is left out.

Result per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.
``removed_spans`` gives the spans themselves.

Defined cases: a null text is an empty text; texts under ``WIDTH`` bytes keep
all; a null ``doc_id`` is carried along; repeated rows are each other's
copies and lose what they share; an empty table gives no rows; other columns
are ignored; texts of any length are treated whole.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codecensus.llm.common import body, mix, read, stored
from codecensus.llm.suffix_groups import equal_windows, suffix_arrays

WIDTH = 200
GRAMS = (48, 150, 190, 200)  # bytes of the anchors' grams, level by level; the last is WIDTH
LIMIT = 4096  # different segments of an anchor that are sorted together, under 1.5 MB
SLICE = 1 << 20  # bytes that are hashed or sorted together
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for b in (BASE, INVERSE):
        p = np.full(n, np.uint64(b))
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of byte * BASE**place (modulo 2**64): the hash of a part is the
    difference of two of them, times INVERSE**place."""
    power, _ = _powers(1 << max(16, int(len(data)).bit_length()))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:len(data)], out=sums[1:])
    return sums


def sliding_least(h: np.ndarray, w: int) -> np.ndarray:
    """Least value of each ``w`` neighbours."""
    n = len(h)
    grid = np.full(-(-n // w) * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    grid[:n] = h
    grid = grid.reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - w + 1], ahead[w - 1:n])


def segments(data: np.ndarray, offsets: np.ndarray, k: int, width: int):
    """Anchor, content hash, list index, start and number of windows of each
    segment of the byte strings between the offsets, and whether its anchor
    has several places in it."""
    none = (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3 + (np.zeros(0, bool),)
    if len(data) < width:
        return none
    sums = prefix_sums(data)
    _, inverse = _powers(1 << max(16, int(len(data)).bit_length()))
    grams = mix((sums[k:] - sums[:-k]) * inverse[:len(data) - k + 1])
    anchor = sliding_least(grams, width - k + 1)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:len(anchor)]
    inside = np.arange(len(anchor)) + width <= offsets[1:][owner]
    at = np.flatnonzero(inside)
    if not len(at):
        return none
    new = np.append(True, (anchor[at][1:] != anchor[at][:-1]) | (owner[at][1:] != owner[at][:-1]))
    first = np.flatnonzero(new)
    start, windows = at[first], np.diff(np.append(first, len(at)))
    stop = start + windows + width - 1
    content = mix((sums[stop] - sums[start]) * inverse[start] + windows.astype(np.uint64))
    span = windows + width - k  # places of grams in the segment
    ends = np.cumsum(span)
    places = np.repeat(start - ends + span, span) + np.arange(ends[-1])
    times = np.add.reduceat((grams[places] == np.repeat(anchor[start], span)).astype(np.int64), ends - span)
    return anchor[start], content, owner[start], start - offsets[:-1][owner[start]], windows, times > 1


def _slices(offsets: np.ndarray, most: int):
    at, n = 0, len(offsets) - 1
    while at < n:
        to = min(max(int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1, at + 1), n)
        yield at, to
        at = to


def _bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Data and offsets of an Arrow binary column without nulls."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


SEGMENT = "anchor long, content long, doc_id long, crc long, start int, windows int, inner boolean"


def _cut(rows: DataFrame, k: int, width: int) -> DataFrame:
    """Segments of all windows of ``rows`` (doc_id, crc, data, and, if only
    parts are wanted, ``parts`` array<struct<start,windows>>)."""
    parted = "parts" in rows.columns

    def run(batches):
        for batch in batches:
            data, offsets = _bytes(batch.column("data"))
            parts = batch.column("parts").to_pylist() if parted else None
            for a, b in _slices(offsets, SLICE):
                if parted:  # each part is a byte string of its own
                    places = [(i, p["start"], p["start"] + p["windows"] + width - 1) for i in range(a, b) for p in parts[i]]
                    pieces = [data[offsets[i] + s:offsets[i] + e] for i, s, e in places]
                    ends = np.cumsum([0, *(len(x) for x in pieces)])
                    anchor, content, of, start, windows, inner = segments(np.concatenate(pieces), ends, k, width)
                    doc = np.array([i for i, _, _ in places], np.int64)[of]
                    start = start + np.array([s for _, s, _ in places], np.int64)[of]
                else:
                    anchor, content, of, start, windows, inner = segments(
                        data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], k, width)
                    doc = of + a
                pick = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), batch.column("doc_id").take(pick),
                     batch.column("crc").take(pick), pa.array(start.astype(np.int32)), pa.array(windows.astype(np.int32)),
                     pa.array(inner)], names=[x.split()[0] for x in SEGMENT.split(", ")])

    return rows.mapInArrow(run, SEGMENT)


SHARED = SEGMENT + ", place int, many boolean"


def _shared(found: DataFrame) -> DataFrame:
    """The segments whose anchor has several places. Of equal segments
    the last has ``place`` (0, 1, ... among its anchor's different ones) and
    ``many`` (whether there are several); the others have place -1.

    Segments are dealt by anchor, sorted and streamed; a task keeps one row.
    """
    dealt = found.repartition("anchor").sortWithinPartitions("anchor", "content")
    names = [x.split()[0] for x in SHARED.split(", ")]

    def run(batches):
        held, before = None, (0, 0, 0)  # last row; rows of its anchor and content before it, its place
        for batch in batches:
            table = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            out, held, before = _runs(table, before, False)
            if out is not None:
                yield pa.RecordBatch.from_arrays(out, names=names)
        if held is not None:
            out, _, _ = _runs(held, before, True)
            if out is not None:
                yield pa.RecordBatch.from_arrays(out, names=names)

    return dealt.mapInArrow(run, SHARED)


def _runs(batch: pa.RecordBatch, before: tuple[int, int, int], last: bool):
    """Treat all rows but the last one (unless ``last``), which waits for
    what follows it."""
    n = batch.num_rows
    if not n:
        return None, None, before
    anchor, content = batch.column("anchor").to_numpy(), batch.column("content").to_numpy()
    new_anchor = np.append(True, anchor[1:] != anchor[:-1])
    new_content = new_anchor | np.append(True, content[1:] != content[:-1])
    new_anchor[0] = new_content[0] = False  # the first row goes on with ``before``
    rows = np.arange(n)
    a0 = np.maximum.accumulate(np.where(new_anchor, rows, -1))
    c0 = np.maximum.accumulate(np.where(new_content, rows, -1))
    in_anchor = np.where(a0 < 0, before[0] + rows, rows - a0)  # rows of the anchor before this one
    in_content = np.where(c0 < 0, before[1] + rows, rows - c0)
    steps = np.cumsum(new_content & ~new_anchor)
    place = np.where(a0 < 0, before[2] + steps, steps - steps[np.maximum(a0, 0)])
    done = n if last else n - 1
    ends_content = np.append(new_content[1:], last)
    ends_anchor = np.append(new_anchor[1:], last)
    shared = (in_anchor > 0) | ~ends_anchor | batch.column("inner").to_numpy(zero_copy_only=False)
    keep = np.flatnonzero(shared[:done])
    out = None
    if len(keep):
        own = ends_content[keep]
        part = batch.take(pa.array(keep))
        out = [*part.columns, pa.array(np.where(own, place[keep], -1).astype(np.int32)), pa.array(in_content[keep] > 0)]
    if last:
        return out, None, (0, 0, 0)
    return out, batch.slice(n - 1, 1), (int(in_anchor[-1]), int(in_content[-1]), int(place[-1]))


REPEATED = "anchor long, content long, spans array<int>"


def _repeated(texts: DataFrame, width: int) -> DataFrame:
    """``texts``: anchor, content, many, data: the different segments. Returns
    the ranges of repeated windows of each (first, end, first, end, ...)."""
    dealt = texts.repartition("anchor").sortWithinPartitions("anchor", "content")

    def run(batches):
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("anchor", "content", "many", "data")]
            for row in zip(*columns, strict=True):
                if size >= SLICE and row[0] != rows[-1][0]:
                    yield from _sorted(rows, width)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[3])
        if rows:
            yield from _sorted(rows, width)

    return dealt.mapInArrow(run, REPEATED)


def _sorted(rows: list[tuple], width: int):
    """Suffix arrays of all anchors of ``rows`` and the windows they repeat."""
    unique = [rows[0], *(r for p, r in zip(rows, rows[1:], strict=False) if p[:2] != r[:2])]  # repeated rows name one segment twice
    sizes = np.array([len(r[3]) for r in unique], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1  # a separator ends each segment
    symbols = np.zeros(int((sizes + 1).sum()), np.int64)
    data = np.frombuffer(b"".join(r[3] for r in unique), np.uint8)
    place = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(data))
    symbols[place] = data.astype(np.int64) + 1
    anchors = np.array([r[0] for r in unique], np.int64)
    head = np.flatnonzero(np.append(True, anchors[1:] != anchors[:-1]))
    offsets = np.append(starts[head], len(symbols))
    suffixes = suffix_arrays(symbols, offsets)
    segment = np.repeat(np.arange(len(unique)), sizes + 1)
    whole = suffixes + width <= (starts + sizes)[segment[suffixes]]  # suffixes that start with a window
    suffixes = suffixes[whole]
    owner = np.searchsorted(head, segment[suffixes], side="right")
    equal = equal_windows(symbols, suffixes, owner, width)
    first = np.flatnonzero(np.append(True, ~equal))
    weight = np.array([1 + bool(r[2]) for r in unique], np.int64)[segment[suffixes]]
    total = np.add.reduceat(weight, first)
    hit = np.zeros(len(symbols) + 1, np.int8)
    hit[suffixes[np.repeat(total > 1, np.diff(np.append(first, len(suffixes))))]] = 1
    edge = np.flatnonzero(np.diff(hit, prepend=0))
    begin, end = edge[::2], edge[1::2]
    if not len(begin):
        return
    of = segment[begin]
    cut = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    spans = np.stack([begin - starts[of], end - starts[of]], axis=1).reshape(-1)
    own = of[cut]
    yield pa.RecordBatch.from_arrays(
        [pa.array(anchors[own]), pa.array(np.array([unique[i][1] for i in own], np.int64)),
         pa.ListArray.from_arrays(pa.array(np.append(cut, len(of)).astype(np.int32) * 2), pa.array(spans.astype(np.int32)))],
        names=["anchor", "content", "spans"])


def _of_doc(texts: DataFrame, lists: DataFrame) -> DataFrame:
    """Texts with the list that a document has; both have doc_id and crc. The
    lists grow with the documents, so both sides are dealt out at every size."""
    own = lists.select(F.col("doc_id").alias("d"), F.col("crc").alias("c"), lists.columns[-1])
    return texts.join(own.hint("merge"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("crc") == F.col("c"))).drop("d", "c")


def _texts_of(owned: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """anchor, content, many, data of the segments with a place."""
    lists = owned.groupBy("doc_id", "crc").agg(F.collect_list(F.struct("anchor", "content", "start", "windows", "many")).alias("own"))
    return _of_doc(texts, lists).select("data", F.explode("own").alias("s")).select(
        "s.anchor", "s.content", "s.many", F.substring(F.col("data"), F.col("s.start") + 1, F.col("s.windows") + F.lit(width - 1)).alias("data"))


def repeated_ranges(texts: DataFrame, width: int, levels: tuple[int, ...], limit: int, parts: DataFrame | None = None) -> DataFrame:
    """(doc_id, crc, start, spans): ranges of repeated windows, counted from
    the segment's start. ``texts``: doc_id, crc, data."""
    rows = texts if parts is None else _of_doc(texts, parts)
    shared = stored(_shared(_cut(rows, levels[0], width)), "segments")
    owned = shared.filter("place >= 0")
    common = shared.filter(F.col("place") == limit).select("anchor")  # one row for each anchor beyond the limit
    deeper = len(levels) > 1 and not common.isEmpty()
    if deeper:
        owned = owned.join(common, "anchor", "left_anti")
    spans = stored(_repeated(_texts_of(owned, texts, width), width), "repeated")
    found = shared.select("anchor", "content", "doc_id", "crc", "start").join(spans, ["anchor", "content"]).select(
        "doc_id", "crc", "start", "spans")
    if not deeper:
        return found
    again = shared.join(common, "anchor", "left_semi").groupBy("doc_id", "crc").agg(
        F.collect_set(F.struct("start", "windows")).alias("parts"))
    return found.unionByName(repeated_ranges(texts, width, levels[1:], limit, stored(again, "common-parts")))


def removed_spans(docs: DataFrame, width: int = WIDTH, levels: tuple[int, ...] = GRAMS, limit: int = LIMIT) -> DataFrame:
    """One row for each different (doc_id, crc) that loses bytes: doc_id,
    crc, spans (start and end of each removed run), kept (bytes that stay)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.crc32(body()).alias("crc"),
                        body().cast("binary").alias("data"))
    long_ = texts.filter(F.length("data") >= width)
    ranges = repeated_ranges(long_, width, levels, limit)
    flat = F.flatten(F.collect_list(F.transform("spans", lambda x: x + F.col("start"))))
    lists = ranges.groupBy("doc_id", "crc").agg(flat.alias("ranges"))

    def run(batches):
        for batch in batches:
            spans, kept = [], []
            for data, ranges_ in zip(batch.column("data"), batch.column("ranges"), strict=True):
                text = data.as_py()
                found = ranges_.values.to_numpy().reshape(-1, 2)
                found = found[np.argsort(found[:, 0], kind="stable")]
                start, end = found[:, 0], np.maximum.accumulate(found[:, 1]) + width - 1
                cut = np.flatnonzero(np.append(True, start[1:] > end[:-1]))
                runs = list(zip(start[cut].tolist(), end[np.append(cut[1:], len(end)) - 1].tolist(), strict=True))
                spans.append([{"start": a, "end": b} for a, b in runs])
                edges = [0, *(x for r in runs for x in r), len(text)]
                kept.append(b"".join(text[edges[i]:edges[i + 1]] for i in range(0, len(edges), 2)))
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("crc"), pa.array(spans, kind),
                                              pa.array(kept, pa.binary())], names=["doc_id", "crc", "spans", "kept"])

    return _of_doc(long_, lists).mapInArrow(
        run, "doc_id long, crc long, spans array<struct<start:int,end:int>>, kept binary")


def suffix_dedup(docs: DataFrame, width: int = WIDTH, levels: tuple[int, ...] = GRAMS, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    cut = stored(removed_spans(docs, width, levels, limit).select(
        F.col("doc_id").alias("d"), F.col("crc").alias("c"), F.size("spans").cast("long").alias("n_spans"),
        F.length("kept").cast("long").alias("n_kept"), F.sha2("kept", 256).alias("sha")).distinct(), "removed")
    text = body().cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.crc32(body()).alias("crc"),
                       F.length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("own"))
    return rows.join(cut, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("crc") == F.col("c")), "left").select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.coalesce("n_kept", "n_bytes")).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("sha", "own").alias("kept_sha256"))


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return suffix_dedup(read(spark, sf_dir, "documents"))
