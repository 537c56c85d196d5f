"""The corpus pipeline and its stages against plain Python."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from codecensus.llm.bpe_codec import default_tokenizer
from codecensus.llm.quality import quality
from llm_fixtures import empty, near_classes, prose

LEAKED = " ".join(f"w{i}" for i in random.Random(2).sample(range(40, 80), 20))
ITEMS = [(1, LEAKED), (2, "pack my box with five dozen liquor jugs and send them far away to the north"), (3, None)]


def corpus(seed=5):
    """(doc_id, text, lang, kind): prose, junk, copies, near copies, leaks, nulls."""
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.choice([30, 60, 90]), 80), "en" if i % 3 else None, "prose") for i in range(150)]
    rows += [(200 + i, " ".join(f"J{rng.randrange(10**6)}!!" for _ in range(40)), "en", "junk") for i in range(8)]
    rows += [(300 + i, rows[i][1], rows[i][2], "copy") for i in range(10)] + [(5, rows[5][1], rows[5][2], "repeat")] * 2
    for i in range(10, 20):
        words = rows[i][1].split()
        words[-1] = "w1"
        rows.append((400 + i, " ".join(words), "en", "near"))
    rows += [(500 + i, f"{prose(rng, 40, 80)} {LEAKED} {prose(rng, 20, 80)}", "en", "leak") for i in range(4)]
    rows += [(600, None, "en", "empty"), (601, "", None, "empty"), (None, "", "en", "empty"), (None, prose(rng, 50, 80), "en", "prose"),
             (None, rows[0][1], rows[0][2], "copy"), (700, rows[7][1] + " ", rows[7][2], "spaced")]
    return rows


LABELS = [(i, 1) for i in range(120)] + [(200, 0), (None, 1), (130, None)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pipeline"))
    rows = corpus()
    docs = spark.createDataFrame([(d, t, a, f"s{k}", len(t or "")) for d, t, a, k in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("*", F.lit("clash").alias("_mark"), F.lit(7).alias("_id"), F.lit("x").alias("__of"), F.lit(1).alias("key"))
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(LABELS, "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def plain_exact(rows):
    best = {}
    for d, t, *_ in rows:
        best.setdefault(t or "", set()).add(d)
    out = set()
    for text, ids in best.items():
        known = [d for d in ids if d is not None]
        out.add((max(known) if known else None, text))
    return out


def plain_near(rows):
    of = near_classes(rows)
    groups = {}
    for i, g in enumerate(of):
        groups.setdefault(g, []).append(rows[i])
    out = set()
    for own in groups.values():
        known = [r for r in own if r[0] is not None]
        out |= {min(known, key=lambda r: r[0])} if known else set(own)
    return out


def _set(df):
    got = Counter((r.doc_id, r.text or "") for r in df.collect())
    assert not got or max(got.values()) == 1
    return set(got)


def test_each_stage_and_the_whole(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns = docs.columns
    rows = corpus()

    first = cp.quality_stage(spark, docs, tables)
    assert first.columns == columns
    rejected = {(r.doc_id, r.mark) for r in quality(docs, spark.read.parquet(f"{tables}/labels.parquet")).filter("NOT kept").collect()}
    kept = [(r.doc_id, r.text) for r in first.collect()]
    assert len(kept) + len(rejected) == len(rows)
    assert not {r[0] for r in rows if r[3] == "junk"} & {d for d, _ in kept}
    assert sum(r[3] != "junk" for r in rows) - len(kept) <= 3  # clean documents stay

    first.write.parquet(f"{tables}/first.parquet")
    second = cp.exact_dedup_stage(spark, spark.read.parquet(f"{tables}/first.parquet"), tables)
    assert second.columns == columns
    want = plain_exact(kept)
    assert _set(second) == want

    third = cp.near_dedup_stage(spark, second, tables)
    assert third.columns == columns
    want = plain_near(sorted(want, key=repr))
    assert _set(third) == want

    fourth = cp.decontamination_stage(spark, third, tables)
    assert fourth.columns == columns
    want = {r for r in want if LEAKED not in r[1]}
    assert _set(fourth) == want

    tok = Tokenizer.from_file(default_tokenizer())
    tok.no_truncation()
    tok.no_padding()

    def digest(d, text):
        ids = tok.encode(text, add_special_tokens=False).ids
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        return d, len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))

    whole = cp.run(spark, tables)
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in whole.collect()), key=repr)
    assert got == sorted((digest(*r) for r in want), key=repr)


def test_stages_of_empty_tables(spark, tmp_path):
    path = str(tmp_path)
    empty(spark).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in cp.STAGES:
        assert stage(spark, docs, path).count() == 0
    assert cp.run(spark, path).count() == 0
