"""Code search over an inverted index of three-letter grams.

The index is a folder with three tables:

* ``postings`` (repo, stretch, gram, places): which files of a stretch of
  32,768 listing places hold a gram of their lower-cased text, by their place
  in the stretch; in folders by the gram's hash and sorted by gram, so that a
  search reads the rows of its own grams only. A gram may have several rows of
  a stretch;
* ``texts`` (repo, block, file_seq, path, content), in folders by a hash of
  (repo, block) and sorted by block, which is 64 consecutive listing places;
* ``files`` (repo, file_seq): what each generation indexed or removed.

New, changed and removed files are a further generation; the newest one of a
file counts. A search intersects the files of its grams, reads the texts of
the blocks that are left and tests them, so its result is exact; a text
shorter than three letters is searched by reading everything.

The grams of a text are many times its rows, so they are found and packed
inside tasks: texts of a stretch come together, and an Arrow batch of them
gives one row for each gram with the places of all its files.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRAM, BLOCK = 3, 64
#: bits of a place in its stretch
PLACE = 15
#: letters of a text that are cut into grams at once
PIECE = 4096
#: letters whose grams a task packs at once
LETTERS = 4_000_000
#: blocks whose numbers are pushed down to the scan of the texts; more are
#: joined by their folder
PUSHED_BLOCKS = 1000


@dataclass(frozen=True)
class Index:
    """Where an index lies and how many folders its tables have: more of them
    let a search read less, and an index of little text needs few."""

    path: str
    gram_folders: int = 64
    text_folders: int = 256


PACKED = "repo string, stretch bigint, gram string, places array<smallint>"
POSTINGS = f"{PACKED}, gen int, folder int"
TEXTS = "repo string, block bigint, file_seq bigint, path string, content string, gen int, folder int"
FILES = "repo string, file_seq bigint, gen int"


def _block() -> Column:
    return F.expr(f"file_seq div {BLOCK}")


def _text_folder(index: Index) -> Column:
    return (F.crc32(F.concat("repo", F.lit("/"), F.col("block").cast("string"))) % index.text_folders).cast("int")


def _grams_of(pieces: pa.RecordBatch, texts: list[str], groups: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Packed grams of some pieces (repo, stretch, place). A key of 64 bits
    holds the group (repo and stretch), three letters and the place; the
    letters are numbered by those that occur. Pieces with too many different
    letters for it are taken by halves."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    if len(codes) < GRAM:
        return
    occurs = np.zeros(0x110000, bool)
    occurs[codes] = True
    alphabet = np.flatnonzero(occurs).astype(np.uint32)
    bits, groups = int(len(alphabet)).bit_length(), groups - groups[0]
    if int(groups[-1]).bit_length() + GRAM * bits + PLACE > 64:
        half = len(texts) // 2
        yield from _grams_of(pieces.slice(0, half), texts[:half], groups[:half])
        yield from _grams_of(pieces.slice(half), texts[half:], groups[half:])
        return
    number = np.zeros(0x110000, np.uint64)
    number[alphabet] = np.arange(len(alphabet), dtype=np.uint64)
    letters = number[codes]
    lengths = np.array([len(t) for t in texts])
    head = groups.astype(np.uint64) << np.uint64(GRAM * bits + PLACE) | pieces.column("place").to_numpy().astype(np.uint64)
    keys, many = np.repeat(head, lengths)[:1 - GRAM], len(codes) - GRAM + 1
    for k in range(GRAM):
        keys |= letters[k:k + many] << np.uint64(bits * (GRAM - 1 - k) + PLACE)
    whole, ends = np.ones(many, bool), np.cumsum(lengths)
    for k in range(1, GRAM):  # a gram lies in one piece
        over = ends - k
        whole[over[(over >= 0) & (over < many)]] = False
    keys = keys[whole]
    keys.sort()
    keys = keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys
    grams = keys >> np.uint64(PLACE)
    starts = np.flatnonzero(np.append(True, grams[1:] != grams[:-1])) if len(keys) else np.zeros(0, np.int64)
    grams, last = grams[starts], np.uint64((1 << bits) - 1)
    found = np.stack([alphabet[(grams >> np.uint64(bits * (GRAM - 1 - k))) & last] for k in range(GRAM)], 1).tobytes().decode("utf-32-le")
    first = pa.array(np.searchsorted(groups, (grams >> np.uint64(bits * GRAM)).astype(np.int64)))
    yield pa.RecordBatch.from_arrays([
        pieces.column("repo").take(first), pieces.column("stretch").take(first),
        pa.array([found[i:i + GRAM] for i in range(0, len(found), GRAM)], pa.string()),
        pa.ListArray.from_arrays(pa.array(np.append(starts, len(keys)).astype(np.int32)),
                                 pa.array((keys & np.uint64((1 << PLACE) - 1)).astype(np.int16)))], ["repo", "stretch", "gram", "places"])


def _packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``PACKED`` from pieces (repo, stretch, place, piece) that come
    sorted by repo and stretch."""
    for batch in batches:
        texts = batch.column("piece").to_pylist()
        of = list(zip(batch.column("repo").to_pylist(), batch.column("stretch").to_pylist(), strict=True))
        groups = np.cumsum([0, *(a != b for a, b in zip(of, of[1:]))])
        at = np.cumsum([len(t) for t in texts]) // LETTERS
        cuts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(texts)]
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                yield from _grams_of(batch.slice(a, b - a), texts[a:b], groups[a:b])


def postings(contents: DataFrame) -> DataFrame:
    """(repo, stretch, gram, places) of all texts. A text is cut into pieces
    that overlap by two letters, so no row holds the grams of a long one."""
    text, seq = F.col("text"), F.col("file_seq").cast("bigint")
    overlapping = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{1,{PIECE + GRAM - 1}}})).{{1,{PIECE}}}"), 1)
    texts = contents.where(F.col("content").isNotNull() & F.col("repo").isNotNull() & F.col("file_seq").isNotNull()).select(
        "repo", F.shiftright(seq, PLACE).alias("stretch"), seq.bitwiseAND((1 << PLACE) - 1).cast("smallint").alias("place"),
        F.lower("content").alias("text"))
    together = texts.hint("rebalance", "repo", "stretch").sortWithinPartitions("repo", "stretch")
    pieces = together.select("repo", "stretch", "place",
                             F.explode(F.when(F.length(text) > PIECE, overlapping).otherwise(F.array(text))).alias("piece"))
    return pieces.mapInArrow(_packed, PACKED)


def add_to_index(index: Index, gen: int, contents: DataFrame, removed: DataFrame | None = None) -> None:
    """Write generation ``gen``: new or changed files (repo, file_seq, path,
    content) and ``removed`` ones (repo, file_seq)."""
    by_gram = postings(contents).withColumn("folder", (F.crc32("gram") % index.gram_folders).cast("int"))
    (by_gram.hint("rebalance", "folder").sortWithinPartitions("folder", "gram")
     .write.partitionBy("folder").parquet(f"{index.path}/postings/gen={gen}"))
    texts = contents.select("repo", _block().alias("block"), "file_seq", "path", "content").withColumn("folder", _text_folder(index))
    (texts.hint("rebalance", "folder").sortWithinPartitions("folder", "repo", "block")
     .write.partitionBy("folder").parquet(f"{index.path}/texts/gen={gen}"))
    files = contents.select("repo", "file_seq")
    if removed is not None:
        files = files.unionByName(removed.select("repo", "file_seq"))
    files.write.parquet(f"{index.path}/files/gen={gen}")


def _table(spark: SparkSession, index: Index, name: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{index.path}/{name}")


def _in_scope(df: DataFrame, owner: str | None, repo: str | None) -> DataFrame:
    if repo is not None:
        return df.where(F.col("repo") == (f"{owner}/{repo}" if owner else repo))
    if owner is not None:
        return df.where(F.col("repo").startswith(f"{owner}/"))
    return df


def candidate_blocks(spark: SparkSession, index: Index, text: str, owner: str | None = None, repo: str | None = None) -> DataFrame:
    """(repo, block) where some file may hold the text: in no other does one
    file hold all of its grams."""
    wanted = text.lower()
    grams = sorted({wanted[i:i + GRAM] for i in range(len(wanted) - GRAM + 1)})
    folders = sorted({zlib.crc32(g.encode()) % index.gram_folders for g in grams})
    own = _in_scope(_table(spark, index, "postings", POSTINGS), owner, repo).where(F.col("folder").isin(folders) & F.col("gram").isin(grams))
    places = own.select("repo", "stretch", "gram", F.explode("places").alias("place"))
    files = places.select("repo", (F.shiftleft("stretch", PLACE) + F.col("place")).alias("file_seq"), "gram").distinct()  # of all generations
    return (files.groupBy("repo", "file_seq").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(grams))
            .select("repo", _block().alias("block")).distinct())


def search_index(spark: SparkSession, index: Index, text: str, owner: str | None = None, repo: str | None = None) -> DataFrame:
    """(repo, path, file_seq): all files whose newest text contains ``text``
    (case-insensitive), in one repository, in all of an owner's, or anywhere."""
    texts = _in_scope(_table(spark, index, "texts", TEXTS), owner, repo)
    if len(text) >= GRAM:
        blocks = candidate_blocks(spark, index, text, owner, repo)
        few = blocks.limit(PUSHED_BLOCKS + 1).collect()
        if len(few) <= PUSHED_BLOCKS:
            numbers = sorted({b.block for b in few})
            folders = sorted({zlib.crc32(f"{b.repo}/{b.block}".encode()) % index.text_folders for b in few})
            texts = texts.where(F.col("folder").isin(folders) & F.col("block").isin(numbers))
        else:
            # one row a folder at most; the predicate lets Spark prune folders at run time
            folders = blocks.select(_text_folder(index).alias("folder")).where(F.col("folder") < index.text_folders).distinct()
            texts = texts.join(F.broadcast(folders), "folder", "left_semi")
    found = texts.where(F.lower("content").contains(text.lower())).select("repo", "path", "file_seq", "gen")
    newest = (_in_scope(_table(spark, index, "files", FILES), owner, repo)
              .groupBy("repo", "file_seq").agg(F.max("gen").alias("gen")))
    return found.join(newest, ["repo", "file_seq", "gen"], "left_semi").select("repo", "path", "file_seq")
