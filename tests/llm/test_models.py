"""Decontamination, toxicity and quality."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from codecensus.llm import decontamination as dc
from codecensus.llm import quality as q
from codecensus.llm import toxicity as tx
from llm_fixtures import documents, empty, frame, prose


def test_align_is_smith_waterman():
    rng = random.Random(0)
    for _ in range(50):
        a = [rng.randrange(4) for _ in range(rng.randrange(1, 12))]
        b = [rng.randrange(4) for _ in range(rng.randrange(1, 20))]
        h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (dc.MATCH if x == y else dc.MISMATCH), h[i - 1][j] + dc.GAP, h[i][j - 1] + dc.GAP)
        score, end = dc.align(np.array([a + [dc.PAD]]), np.array([b + [dc.PAD + 1] * 3]))
        assert score[0] == max(map(max, h))
        if score[0]:
            assert any(row[end[0] + 1] == score[0] for row in h)


def edited(rng, words, part):
    out = []
    for w in words:
        u = rng.random()
        out += [] if u < part / 4 else [f"z{rng.randrange(999)}"] if u < part else [w]
    return out


@pytest.mark.parametrize("block", [8 << 20, 300])
def test_leaks(spark, block):
    rng = random.Random(5)
    items = [(i, prose(rng, 30)) for i in range(12)] + [(50, None), (51, ""), (52, "two words"), (None, "an item of no id but with words")]
    docs, want = [], set()
    for i, (k, t) in enumerate(items[:12]):
        for copy, part in enumerate((0.0, 0.0, 0.2)):
            d = i * 10 + copy
            body = prose(rng, 60).split() + edited(rng, t.upper().split() if copy == 1 else t.split(), part) + prose(rng, 60).split()
            docs.append((d, (", " if copy == 1 else " ").join(body)))
            want.add((d, k))
    docs += [(1000 + i, prose(rng, 150)) for i in range(60)] + [(2000, None), (2001, ""), (2002, "here are two words"),
                                                             (2003, prose(rng, 5000) + " " + items[3][1])]
    docs += [(3000 + i, items[0][1]) for i in range(300)]  # a hot item
    want |= {(2002, 52), (2003, 3)} | {(3000 + i, 0) for i in range(300)}
    bench = spark.createDataFrame([(*x, "x") for x in items], "item_id long, text string, hashes string")
    got = dc.contaminated(frame(spark, docs), bench, block_bytes=block).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    at = {(r.doc_id, r.item_id): r for r in got}
    assert (at[0, 0].first_word, at[0, 0].last_word, at[0, 0].similarity) == (60, 89, 1.0)


def test_leaks_against_brute_force(spark):
    rng = random.Random(3)
    word = lambda: f"v{rng.randrange(20000)}"
    items = [(i, [word() for _ in range((12, 20, 30, 50)[i % 4])]) for i in range(40)]
    docs = []
    for i, words in items:
        for part in (0.1, 0.2, 0.25, 0.3):
            docs.append([word() for _ in range(9)] + [f"z{rng.randrange(999)}" if rng.random() < part else w for w in words] + [word()])
        docs.append([f"y{k}" if k % 5 == 4 else w for k, w in enumerate(words)])
    want, apart = {}, set()
    for i, words in items:
        own = {tuple(words[k:k + 3]) for k in range(len(words) - 2)}
        a = np.array([[hash(w) for w in words]])
        for d, text in enumerate(docs):
            score, _ = dc.align(a, np.array([[hash(w) for w in text]]))
            if score[0] >= dc.LEAK * dc.MATCH * len(words):
                want[d, i] = int(score[0])
                if not own & {tuple(text[k:k + 3]) for k in range(len(text) - 2)}:
                    apart.add((d, i))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score
           for r in dc.contaminated(frame(spark, [(d, " ".join(t)) for d, t in enumerate(docs)]), bench).collect()}
    assert got == {k: v for k, v in want.items() if k not in apart}
    assert len(apart) <= 0.02 * len(want)


def test_leaks_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "some words to find")], "item_id long, text string")
    assert dc.contaminated(frame(spark, documents(n=5)), none).count() == 0
    assert dc.contaminated(empty(spark), one).count() == 0


def test_index_is_exact():
    rng = np.random.default_rng(0)
    rows, terms = 500, 60
    dense = rng.random((rows, terms)) * (rng.random((rows, terms)) < 0.08)
    r, t = np.nonzero(dense)
    index = tx.BlockMaxIndex(r, t, dense[r, t], rows, terms, block=16)
    norm = np.linalg.norm(dense, axis=1)
    for _ in range(40):
        own = np.sort(rng.choice(terms, rng.integers(1, 9), replace=False))
        w = rng.random(len(own)) + 0.1
        cosine = np.nan_to_num(dense[:, own] @ w / (norm * np.linalg.norm(w)))
        _, best = index.nearest(own, w, 10)
        want = np.sort(cosine[cosine > 0])[::-1][:10]
        np.testing.assert_allclose(best, want, rtol=1e-9)


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(7)
    bad = ["vile", "rotten", "awful"]
    docs, labels = [], []
    for i in range(900):
        words = prose(rng, rng.choice([10, 60])).split()
        toxic = int(i % 5 == 0)
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        docs.append((i, " ".join(words)))
        labels.append((i, toxic))
    docs += [(9000, None), (9001, ""), (None, "a vile text"), (9002, "nothing known")]
    labels += [(None, 1), (3, None), (5, 0)]
    df = frame(spark, docs)
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = tx.fit(df, lab, ~tx.held_out())
    got = {r.doc_id: r for r in tx.score(df, model).collect()}
    truth = {i: int(i % 5 == 0) for i in range(900)}
    out = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((got[i].score >= 0.7) == truth[i] for i in out) / len(out) > 0.97
    assert got[9000].score == got[9001].score == got[9002].score < 0.2 and not got[9000].evidence
    assert got[None].score >= 0.7 and got[None].evidence[0].toxic == 1
    assert all(0 <= r.score <= 1 for r in got.values())


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = documents(n=5)
    got = tx.score(frame(spark, rows), tx.fit(frame(spark, rows), none, ~tx.held_out())).collect()
    assert len(got) == len(rows) and {r.score for r in got} == {0.0}
    assert tx.score(empty(spark), tx.fit(empty(spark), none, ~tx.held_out())).count() == 0


def plain_perplexity(train, docs, number, size):
    """Interpolated modified Kneser-Ney of order two, word by word."""
    pair = Counter(p for t in train for p in zip(t, t[1:], strict=False))
    first, seen = defaultdict(list), Counter()
    for (v, w), n in pair.items():
        first[v].append(n)
        seen[w] += 1
    kinds = Counter(pair.values())
    d = q.discounts(np.array([kinds[k] for k in (1, 2, 3, 4)]))
    kinds = Counter(seen.values())
    e = q.discounts(np.array([kinds[k] for k in (1, 2, 3, 4)]))
    total = sum(seen.values())
    spare = sum(e[min(c, 3)] for c in seen.values()) / total if total else 1.0
    p1 = lambda w: (max(seen[w] - (e[min(seen[w], 3)] if seen[w] else 0), 0) / max(total, 1)) + spare / size

    def p2(v, w):
        if v not in first:
            return p1(w)
        c = sum(first[v])
        back = sum(d[min(n, 3)] for n in first[v]) / c
        n = pair.get((v, w), 0)
        return (n - d[min(n, 3)] if n else 0) / c + back * p1(w)

    out = []
    for t in docs:
        ln = [math.log(p1(t[0]))] + [math.log(p2(v, w)) for v, w in zip(t, t[1:], strict=False)] if t else []
        out.append(math.exp(-sum(ln) / len(ln)) if ln else None)
    return out


@pytest.mark.parametrize("hot", [0, 50])
def test_quality_is_kneser_ney(spark, hot):
    rng = random.Random(9)
    rows = [(i, prose(rng, rng.choice([5, 40, 90]), 60)) for i in range(150)]
    rows += [(200 + i, " ".join(f"J{rng.randrange(10**6)}!!" for _ in range(40))) for i in range(10)]
    rows += [(500, None), (501, ""), (600, "twice w1 w2"), (600, "twice w1 w2"), (None, "w1 w2 w3")]
    labels = [(i, 1) for i in range(120)] + [(200, 0), (None, 1), (130, None), (3, 0)]
    df = frame(spark, rows)
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    got = q.quality(df, lab, hot=hot).collect()
    assert Counter(r.doc_id for r in got) == Counter(d for d, _ in rows)
    ids = {r.doc_id for r in q.trusted_ids(lab).filter("NOT held").collect()}
    assert 3 not in ids
    split = lambda t: re.findall(r"\S+", t or "")
    counts = Counter(w for d, t in rows if d in ids for w in split(t))
    known = {w for w, n in counts.items() if n > 1}
    shape = lambda w: w if w in known else q.shape(w)
    train = [[shape(w) for w in split(t)] for d, t in rows if d in ids]
    want = plain_perplexity(train, [[shape(w) for w in split(t)] for _, t in rows], None, len(known) + q.KINDS)
    by = {}
    for (d, _), w in zip(rows, want, strict=True):
        by[d] = w
    for r in got:
        assert (r.perplexity is None) == (by[r.doc_id] is None)
        if r.perplexity:
            assert r.perplexity == pytest.approx(by[r.doc_id], rel=1e-4)
    kept = {r.doc_id: r.kept for r in got}
    assert kept[500] and kept[501] and not any(kept[200 + i] for i in range(10))
    assert sum(kept[i] for i in range(150)) >= 140


def test_quality_empty(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert q.quality(empty(spark), none).count() == 0
    assert all(r.kept for r in q.quality(frame(spark, documents(n=4)), none).collect())
