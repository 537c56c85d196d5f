import zlib
from collections import Counter, defaultdict

from codecensus.llm.sharding import balanced_shards
from llm_fixtures import documents, empty, frame


def test_shards(spark):
    rows = documents(n=300) + [(5000 + i, "hot text") for i in range(200)]
    got = balanced_shards(frame(spark, rows), 7, lane_rows=1).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    counts = [len(slots[s]) for s in range(7)]
    assert max(counts) - min(counts) <= 1 and len(slots) == 7
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = defaultdict(set)
    size = Counter()
    for r in got:
        groups[r.text_crc32].add(r.shard)
        size[r.text_crc32] += 1
    small = [len(groups[g]) for g in groups if 1 < size[g] <= 12]
    assert sum(small) / len(small) < 1.2  # groups that fit a shard stay together
    assert len(groups[zlib.crc32(b"hot text")]) < 7


def test_hot_group_fills_few_shards(spark):
    rows = [(i, "hot text" if i % 3 == 0 else f"text {i}") for i in range(2400)]
    got = balanced_shards(frame(spark, rows), 24).collect()
    sizes = Counter(r.shard for r in got)
    assert len(got) == 2400 and set(sizes.values()) == {100}
    hot = Counter(r.shard for r in got if r.text_crc32 == zlib.crc32(b"hot text"))
    assert sum(hot.values()) == 800 and len(hot) == 8


def test_few_rows(spark):
    assert balanced_shards(empty(spark)).count() == 0
    got = balanced_shards(frame(spark, [(1, "a"), (2, "a")]), 24).collect()
    assert sorted(r.slot for r in got) == [0, 0] and len({r.shard for r in got}) == 2
