import hashlib
from collections import Counter, defaultdict

import pytest

from codecensus.llm.exact_dedup import exact_dedup
from codecensus.llm.near_dedup import link_groups, near_groups, prob_minhash
from llm_fixtures import documents, empty, frame, near_classes


@pytest.mark.parametrize("bits,capacity", [(64, 1_000_000), (4, 2)])
def test_exact_dedup(spark, bits, capacity):
    rows = documents()
    groups = defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(d)
    got = Counter(map(tuple, exact_dedup(frame(spark, rows), capacity, bits).collect()))
    want = Counter()
    for d, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = max(ids) if ids else None
        want[d, keep, len(groups[t or ""]), d is not None and d == keep,
             hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert got == want


def test_index_is_probed_through_several_depths(spark):
    from codecensus.llm.exact_dedup import build_index
    rows = documents(5, 400)
    directory, index = build_index(frame(spark, rows), 32)
    cells = directory.orderBy("cell").collect()
    assert len({r.depth for r in cells}) > 1 and max(r.depth for r in cells) >= 4
    load = {r.bucket: r["count"] for r in index.groupBy("bucket").count().collect()}
    assert max(load.values()) <= 32 and sum(load.values()) == len({t or "" for _, t in rows})
    plan = exact_dedup(frame(spark, rows), 32)._jdf.queryExecution().executedPlan().toString()
    assert "Join [bucket#" in plan.replace("SortMerge", "").replace("BroadcastHash", "").replace("ShuffledHash", "")


def test_exact_dedup_empty(spark):
    assert exact_dedup(empty(spark)).count() == 0


@pytest.mark.parametrize("block,centres", [(1_000_000, 32), (400, 1)])
def test_near_groups(spark, block, centres):
    rows = documents()
    of = near_classes(rows)
    groups = defaultdict(list)
    for i, g in enumerate(of):
        groups[g].append(rows[i][0])
    want = Counter()
    for i, (d, _) in enumerate(rows):
        ids = [x for x in groups[of[i]] if x is not None]
        want[d, min(ids) if ids else None, len(groups[of[i]])] += 1
    got = near_groups(frame(spark, rows), block=block, centres=centres).select("doc_id", "class_id", "class_size")
    assert Counter(map(tuple, got.collect())) == want


def test_near_copies_without_ids_are_linked(spark):
    import random

    from llm_fixtures import prose
    words = prose(random.Random(1), 120).split()
    rows = [(None, " ".join(words)), (None, " ".join([*words[:-1], "other"])), (None, " ".join(words)), (1, "something else entirely, of six words")]
    got = near_groups(frame(spark, rows)).select("doc_id", "class_id", "class_size", "n_texts").collect()
    assert Counter(map(tuple, got)) == Counter({(None, None, 3, 2): 3, (1, 1, 1, 1): 1})


@pytest.mark.parametrize("repeated,times", [(20, 10), (30, 20)])
def test_copies_that_repeat_lines_are_found(spark, repeated, times):
    rng, rows = __import__("random").Random(repeated), []
    for k in range(60):
        words = [f"{rng.randrange(10**9)}" for _ in range(104)]
        line = words[10:10 + repeated + 4]
        other = [*words[:97], *(f"x{i}" for i in range(7))]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other + line * times))]
    got = {r.doc_id: r.class_id for r in near_groups(frame(spark, rows)).collect()}
    pairs = [k for k in range(60) if near_classes([rows[2 * k], rows[2 * k + 1]]) == [0, 0]]
    found = sum(got[2 * k] == got[2 * k + 1] for k in pairs)
    assert found >= 0.9 * len(pairs)


def test_components_of_stars_chains_and_loops(spark):
    import random

    from codecensus.llm.components import components
    rng = random.Random(4)
    edges = [(i, rng.choice([0, 1, 2])) for i in range(10, 3000)] + [(i, i - 1) for i in range(5001, 5060)] + [(7000, 7001), (7001, 7002),
             (7002, 7000), (8, 8), (1, 2), (9000, 3)]
    of = {}

    def find(x):
        while of.setdefault(x, x) != x:
            x = of[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            of[max(a, b)] = min(a, b)
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in of}


def test_near_groups_empty(spark):
    assert near_groups(empty(spark)).count() == 0


def test_prob_minhash_estimates_probability_jaccard():
    import numpy as np

    a, b = np.arange(1, 101, dtype=np.uint64), np.arange(31, 131, dtype=np.uint64)
    wa, wb = 1.0 + (a % np.uint64(3)), 1.0 + (b % np.uint64(4))
    x, y = dict(zip(a.tolist(), wa, strict=True)), dict(zip(b.tolist(), wb, strict=True))
    keys = x.keys() | y.keys()
    want = sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in keys) for i in x.keys() & y.keys())
    m = 4096
    sig = prob_minhash(np.concatenate([a, b]), np.repeat([0, 1], 100), np.concatenate([wa, wb]), 2, m)
    assert abs((sig[0] == sig[1]).mean() - want) < 4 * (want * (1 - want) / m) ** 0.5


def test_link_groups_follow_chains():
    import numpy as np

    sets = [np.arange(k, k + 20, dtype=np.uint64) for k in (0, 1, 2, 3, 50)] + [np.zeros(0, np.uint64)]
    assert link_groups(sets, 0.8).tolist()[:4] == [0, 0, 0, 0]
    assert len(set(link_groups(sets, 0.8).tolist())) == 3
