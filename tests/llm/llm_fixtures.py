"""Small documents with the hard cases, and plain versions of the operators."""

import random

CLASHING = ["h", "key", "bucket", "mark", "g", "label", "anchor", "cell", "rank", "n", "keep_id", "hashes", "d", "c", "crc", "size"]


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{min(rng.randrange(vocabulary), rng.randrange(vocabulary))}" for _ in range(n))


def documents(seed=0, n=60):
    """(doc_id, text): prose, copies, near copies, empties, nulls, repeats."""
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.choice([3, 8, 40, 120]))) for i in range(n)]
    for i in range(12):  # exact copies, one of them hot
        rows.append((n + i, rows[i % 3][1]))
    for i in range(12):  # near copies: a word or two changed
        words = prose(random.Random(100 + i % 4), 120).split()
        for _ in range(i % 3):
            words[rng.randrange(len(words))] = f"x{rng.randrange(99)}"
        rows.append((n + 20 + i, " ".join(words)))
    rows += [(500, None), (501, ""), (502, "  \n "), (503, "a" * 3000), (504, "é" * 500), (505, "ab " * 700),
             (506, "Tie tie"), (507, "tie Tie"), (600, "repeated row here"), (600, "repeated row here"),
             (None, "no id at all"), (None, rows[0][1]), (700, prose(rng, 6000))]
    return rows


def frame(spark, rows, extra=True):
    df = spark.createDataFrame([(d, t, None if i % 9 == 4 else "en" if i % 2 else "fr", f"s{i % 3}")
                                for i, (d, t) in enumerate(rows)], "doc_id long, text string, lang string, source string")
    if extra:
        from pyspark.sql import functions as F

        df = df.select("*", *(F.lit("clash").alias(c) for c in CLASHING))
    return df.repartition(3)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def shingles(text, n=5):
    w = (text or "").lower().split()
    return frozenset(tuple(w[k:k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()


def near_classes(rows, similarity=0.8):
    """Index of the first row of each row's group."""
    sets = [shingles(t) for _, t in rows]
    of = list(range(len(rows)))

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            both = len(a & b)
            if (not a and not b) or (both and both >= similarity * (len(a) + len(b) - both) - 1e-9):
                x, y = find(i), find(j)
                of[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(rows))]
