"""How the sources of a language differ in their terms.

Terms are counted for each (language, source) and kept per language where
enough documents hold them. Every group and the language as a whole gives
each kept term a smoothed share p; the divergence of two shares is
floor((p - q)**2 / (p + q)), all in whole numbers. Reported are each pair of
sources of a language with the divergence summed over all kept terms, and for
each group the terms that it has more of than its language.

Counting is done on packed terms (``packed_terms``): a task turns its texts
into sorted runs and sends one row a (term, language, source), so a frequent
term or a large source is summed before it is shuffled. Terms meet by
(language, term). Pairs are summed in slices of a language's terms of bounded
size; a slice holds the shares of the sources of two tiles as a dense block,
since terms that a source lacks count too, and sends one row a pair.

Defined cases: a null text, language or source is an empty string; a group
without terms has every kept term zero times; a language without kept terms
has pairs of value 0 and no terms; the only source of a language has no
pairs; ties rank by the item's UTF-8 bytes; repeated rows count as documents
of their own; texts and terms of any length are read whole; empty documents
give no rows; ``doc_id`` and other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codecensus.llm.byte_words import LETTERS, pieces
from codecensus.llm.common import body, read, stored
from codecensus.llm.packed_terms import Runs, merged, packed, run_count, strings, width_of

LEAST_DOCS, SHOWN_TERMS = 10, 10
#: runs that a task holds before it sends them; rows of a slice; sources of a
#: tile; cells of a dense block
HELD_RUNS, SLICE_ROWS, TILE, BLOCK_CELLS, SENT_ROWS = 3_000_000, 50_000, 512, 1 << 20, 200_000


class TermCounter:
    """Runs of all texts of a task, by length bucket."""

    def __init__(self):
        self.groups: dict[tuple[str, str], int] = {}
        self.names: list[tuple[str, str]] = []
        self.runs: dict[int, list[Runs]] = defaultdict(list)
        self.held = 0

    def group(self, name: tuple[str, str]) -> int:
        if name not in self.groups:
            self.groups[name] = len(self.names)
            self.names.append(name)
        return self.groups[name]

    def add(self, batch: pa.RecordBatch) -> None:
        own = np.array([self.group(g) for g in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)],
                       np.int64)
        parts: dict[int, list[Runs]] = defaultdict(list)  # of a text that has several pieces
        for piece in pieces(batch.column("text"), LETTERS):
            lengths, rows = piece.stops - piece.starts, piece.owner
            widths = width_of(lengths)
            whole = piece.ends and not parts
            for width in np.unique(widths):
                at = np.flatnonzero(widths == width)
                one = np.ones(len(at), np.int64)
                runs = run_count(packed(piece.data, piece.starts[at], lengths[at], int(width)), lengths[at], own[rows[at]], one, one, rows[at])
                (self.runs if whole else parts)[int(width)].append(runs)
                self.held += whole * len(runs.n)
            if piece.ends and parts:
                for width, found in parts.items():
                    runs = merged(found)
                    runs.docs[:] = 1
                    self.runs[width].append(runs)
                    self.held += len(runs.n)
                parts = defaultdict(list)

    def send(self):
        """Arrow batches of all runs; nothing is held afterwards."""
        langs, sources = (pa.array([g[k] for g in self.names], pa.string()) for k in (0, 1))
        for found in self.runs.values():
            runs = merged(found)
            for i in range(0, len(runs.n), SENT_ROWS):
                part = slice(i, i + SENT_ROWS)
                group = pa.array(runs.group[part])
                yield pa.RecordBatch.from_arrays(
                    [langs.take(group), sources.take(group), strings([k[part] for k in runs.keys], runs.lengths[part]),
                     pa.array(runs.n[part]), pa.array(runs.docs[part])], names=["lang", "source", "term", "n", "docs"])
        self.runs.clear()
        self.held = 0


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs; a task's rows are summed."""

    def run(batches):
        counter = TermCounter()
        for batch in batches:
            counter.add(batch)
            if counter.held > HELD_RUNS:
                yield from counter.send()
        yield from counter.send()

    return docs.select(body("lang").alias("lang"), body("source").alias("source"), body().alias("text")).mapInArrow(
        run, "lang string, source string, term string, n long, docs long")


def kept_terms(docs: DataFrame, least_docs: int) -> DataFrame:
    """lang, term, source, n, total (in the language) of the kept terms, and
    ``lead`` on one row of each (lang, term)."""
    term = Window.partitionBy("lang", "term")
    counted = (term_counts(docs).repartition("lang", "term")
               .groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    return (counted.withColumns({"in_docs": F.sum("docs").over(term), "total": F.sum("n").over(term),
                                 "lead": F.col("source") == F.min("source").over(term)})
            .filter(F.col("in_docs") >= least_docs).select("lang", "term", "source", "n", "total", "lead"))


def share(count: str, total: str) -> Column:
    """Smoothed share of a term in parts of a billion, exact for any count."""
    return F.expr(f"CAST(1 + (CAST(1000000000 AS DECIMAL(10,0)) * CAST({count} + 2 AS DECIMAL(19,0))) "
                  f"div CAST({total} + 2 * terms AS DECIMAL(20,0)) AS BIGINT)")


def divergence(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def group_stats(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """For every occurring (lang, source): its number ``no`` in the language,
    terms and sums of the language (``lang_n``) and the group (``own_n``), the
    share ``p0`` of a term it lacks, and how the language is cut for pairs."""
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.count_if("lead").alias("terms"), F.count(F.lit(1)).alias("rows"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("own_n"))
    lang = Window.partitionBy("lang")
    return (docs.select(body("lang").alias("lang"), body("source").alias("source")).distinct()
            .join(own, ["lang", "source"], "left").join(langs, "lang", "left")
            .fillna(0, ["lang_n", "terms", "rows", "own_n"])
            .withColumns({"no": F.row_number().over(lang.orderBy("source")) - 1, "sources": F.count(F.lit(1)).over(lang)})
            .withColumns({"p0": F.when(F.col("terms") > 0, share("0", "own_n")),
                          "tile": F.expr(f"no div {TILE}"), "tiles": F.expr(f"(sources - 1) div {TILE} + 1"),
                          "slices": F.expr(f"rows div {SLICE_ROWS} + 1")}))


def _pair_sums(key, rows: pa.Table, heads: pa.Table) -> pa.Table:
    """Divergence of the pairs of two tiles' sources over one slice of terms."""
    lang, low, high, _ = (k.as_py() for k in key)
    heads = heads.sort_by("no")
    no, p0 = heads.column("no").to_numpy(), heads.column("p0").to_numpy()
    split = len(no) if low == high else int((heads.column("tile").to_numpy() == low).sum())  # first source of the second tile
    terms = rows.column("term").combine_chunks().dictionary_encode()
    term = terms.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.argsort(term, kind="stable")
    term, source, p = term[order], np.searchsorted(no, rows.column("no").to_numpy()[order]), rows.column("p").to_numpy()[order]
    sums = np.zeros((len(no), len(no)), np.int64)
    n_terms, step = len(terms.dictionary), max(1, BLOCK_CELLS // max(1, len(no)))
    for t in range(0, n_terms, step):
        a, b = np.searchsorted(term, [t, t + step])
        shares = np.repeat(p0[:, None], min(step, n_terms - t), axis=1)
        shares[source[a:b], term[a:b] - t] = p[a:b]
        for i in range(split):
            others = slice(i + 1 if low == high else split, None)
            d, s = shares[others] - shares[i], shares[others] + shares[i]
            sums[i, others] += (d * d // s).sum(axis=1)
    i, j = np.triu_indices(len(no), 1)
    if low != high:
        cross = (i < split) & (j >= split)
        i, j = i[cross], j[cross]
    return pa.table({"lang": pa.array([lang] * len(i), pa.string()), "a": pa.array(no[i], pa.int32()), "b": pa.array(no[j], pa.int32()),
                     "value": pa.array(sums[i, j]), "seen": pa.array(np.full(len(i), n_terms), pa.int64())})


def pair_divergence(kept: DataFrame, stats: DataFrame) -> DataFrame:
    """lang, source, item, value for each ordered pair of a language's sources."""
    def cut(df: DataFrame, slices: Column) -> DataFrame:
        """Copies of a source's rows for each tile that it is paired with."""
        return (df.withColumn("other", F.explode(F.expr("sequence(0L, CAST(tiles - 1 AS BIGINT))")))
                .withColumns({"low": F.least("tile", "other"), "high": F.greatest("tile", "other"), "slice": slices}))

    key = ["lang", "low", "high", "slice"]
    rows = cut(kept.join(stats, ["lang", "source"]).withColumn("p", share("n", "own_n")), F.expr("pmod(xxhash64(term), slices)")).select(
        *key, "no", "term", "p")
    heads = cut(stats.toDF(*stats.columns), F.explode(F.expr("sequence(0L, CAST(slices - 1 AS BIGINT))"))).select(
        *key, "no", "tile", F.coalesce("p0", F.lit(1).cast("long")).alias("p0"))
    sums = (rows.groupBy(*key).cogroup(heads.groupBy(*key)).applyInArrow(_pair_sums, "lang string, a int, b int, value long, seen long")
            .groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen")))
    side = stats.select("lang", "no", "source", "p0", "terms")
    named = (sums.join(side.toDF("lang", "a", "source_a", "p0_a", "terms"), ["lang", "a"])
             .join(side.drop("terms").toDF("lang", "b", "source_b", "p0_b"), ["lang", "b"])
             # terms that neither tile has
             .withColumn("value", F.when(F.col("terms") > 0, F.col("value") + (F.col("terms") - F.col("seen")) * divergence("p0_a", "p0_b"))
                         .otherwise(0)))
    both = F.array(F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")),
                   F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item")))
    return named.select("lang", F.explode(both).alias("of"), "value").select("lang", "of.source", "of.item", "value")


def term_divergence(kept: DataFrame, stats: DataFrame) -> DataFrame:
    """lang, source, item, value of the terms a group has more of than its language."""
    return (kept.join(stats, ["lang", "source"])
            .withColumns({"p": share("n", "own_n"), "q": share("total", "lang_n")}).filter("p > q")
            .select("lang", "source", F.col("term").alias("item"), divergence("p", "q").alias("value")))


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, shown_terms: int | None = SHOWN_TERMS) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank; of the
    terms those of the first ``shown_terms`` ranks, or all."""
    kept = stored(kept_terms(docs, least_docs), "divergence-kept")
    stats = stored(group_stats(docs, kept), "divergence-groups")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).cast("int")
    terms = term_divergence(kept, stats).withColumn("rank", rank)
    if shown_terms is not None:
        terms = terms.filter(F.col("rank") <= shown_terms)
    pairs = pair_divergence(kept, stats).withColumn("rank", rank)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(*columns).unionByName(terms.withColumn("part", F.lit("term")).select(*columns))


def op11_source_divergence(spark, sf_dir: str) -> DataFrame:
    return source_divergence(read(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
    FROM documents
), words AS (
    SELECT d, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (
    SELECT lang, term, count(*) AS total FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= 10
), groups AS (SELECT DISTINCT lang, source FROM docs
), counts AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL
), langs AS (SELECT lang, count(*) AS v, sum(total)::BIGINT AS lang_n FROM kept GROUP BY lang
), own AS (SELECT lang, source, sum(n)::BIGINT AS own_n FROM counts GROUP BY ALL
), shares AS (
    SELECT lang, source, term, coalesce(n, 0) AS n,
           1 + (1000000000::HUGEINT * (coalesce(n, 0) + 2)) // (coalesce(own_n, 0) + 2 * v) AS p,
           1 + (1000000000::HUGEINT * (total + 2)) // (lang_n + 2 * v) AS q
    FROM groups JOIN kept USING (lang) JOIN langs USING (lang)
    LEFT JOIN own USING (lang, source) LEFT JOIN counts USING (lang, source, term)
), pairs AS (
    SELECT a.lang, a.source, b.source AS item,
           coalesce((SELECT sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) FROM shares x JOIN shares y USING (lang, term)
                     WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0)::BIGINT AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
), terms AS (
    SELECT lang, source, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM shares WHERE n > 0 AND p > q
)
SELECT lang, source, 'pair' AS part, item, value,
       row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pairs
UNION ALL
SELECT lang, source, 'term' AS part, item, value, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM terms
) WHERE rank <= 10
"""
