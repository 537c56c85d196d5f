import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from codecensus.llm.suffix_dedup import suffix_dedup
from codecensus.llm.suffix_groups import suffix_arrays
from llm_fixtures import documents, empty, frame


def test_suffix_arrays_of_many_texts():
    rng = random.Random(0)
    for _ in range(200):
        texts = [[rng.randrange(rng.choice([1, 2, 3, 8])) for _ in range(rng.randrange(40))] for _ in range(rng.randrange(1, 8))]
        offsets = np.cumsum([0] + [len(t) for t in texts])
        got = suffix_arrays(np.array([x for t in texts for x in t], np.int64), offsets)
        for k, t in enumerate(texts):
            own = got[offsets[k]:offsets[k + 1]] - offsets[k]
            assert own.tolist() == sorted(range(len(t)), key=lambda i, t=t: t[i:])


def plain(rows, width):
    places = Counter(b[i:i + width] for b in rows for i in range(len(b) - width + 1))
    out = Counter()
    for b in rows:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - width + 1):
            if places[b[i:i + width]] > 1:
                gone[i:i + width] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out[len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("width,levels,limit", [(200, (48, 150, 190, 200), 64), (20, (6, 14, 20), 64), (20, (6, 14, 18, 20), 0)])
def test_suffix_dedup(spark, width, levels, limit):
    rng = random.Random(1)
    rows = documents()
    rows += [(900 + i, "".join(rng.choice(["ab", "a", "ba", "abc "]) for _ in range(rng.randrange(60)))) for i in range(60)]
    got = suffix_dedup(frame(spark, rows), width, levels, limit).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(d) for d, _ in rows)
    assert Counter(tuple(r[1:]) for r in got) == plain([(t or "").encode() for _, t in rows], width)


def test_suffix_dedup_empty(spark):
    assert suffix_dedup(empty(spark)).count() == 0
