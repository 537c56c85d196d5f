"""Source divergence, importance resampling and licence scan against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from llm_fixtures import CLASHING, documents, empty, frame

from codecensus.llm import byte_words, source_divergence
from codecensus.llm.byte_words import LETTERS_DIGITS, pieces
from codecensus.llm.crc_spans import BLOCK, span_crcs
from codecensus.llm.importance_resampling import importance_resample
from codecensus.llm.licence_texts import PHRASES, TEMPLATES
from codecensus.llm.license_scan import Notices, license_scan, scan, words
from codecensus.llm.packed_terms import PACKED, packed, run_count, strings, width_of
from codecensus.llm.source_divergence import source_divergence as divergence
from codecensus.llm.suffix_automaton import SuffixAutomaton

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


HARD = [None, "", " ", "one", "É à_É1é ÉÉ", "ab1cd", "\x00a\x00b", "x" * 5000, "ż" * 300 + " y", "a.b-c  d", "AZaz[`{@", "😀 k😀k"]


@pytest.mark.parametrize("size", [3, 17, 64, byte_words.PIECE])
def test_pieces_hold_every_word_once(size):
    texts = [t or "" for t in HARD] + [t or "" for _, t in documents(3, 12)]
    column = pa.array(texts).slice(0)
    found = defaultdict(list)
    for piece in pieces(column, LETTERS_DIGITS, back=2, size=size):
        of = piece.owner
        for i in range(piece.repeated, len(of)):
            found[int(of[i])].append(piece.data[piece.starts[i]:piece.stops[i]].tobytes().decode())
    assert [found[i] for i in range(len(texts))] == [WORD.findall(lower(t)) for t in texts]


def test_crcs_of_spans_of_every_length():
    rng = random.Random(5)
    data = np.frombuffer(rng.randbytes(120_000), np.uint8)
    lengths = [*range(1, 3 * BLOCK + 2), 1000, 4096, 65_537, 100_001] + [rng.randrange(1, 700) for _ in range(200)]
    starts = [rng.randrange(len(data) - n) for n in lengths]
    got = span_crcs(data, np.array(starts), np.array(lengths))
    assert [int(c) for c in got] == [zlib.crc32(data[s:s + n].tobytes()) for s, n in zip(starts, lengths, strict=True)]


def plain_resample(rows, target, buckets, longest, least, percent):
    def features(text):
        w = WORD.findall(lower(text))
        return w, [zlib.crc32(" ".join(w[i:i + r]).encode()) % buckets for r in range(1, longest + 1) for i in range(len(w) - r + 1)]

    own, wanted = [features(t) for _, t in rows], [features(t) for t in target]
    s, t = Counter(b for _, f in own for b in f), Counter(b for _, f in wanted for b in f)
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (t_s + buckets) / ((s[b] + 1) * (t_t + buckets))))
            for t_s, t_t in [(s.total(), t.total())] for b in s}
    out = []
    for (d, _), (w, f) in zip(rows, own, strict=True):
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f) // max(1, len(f))
        out.append((d, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], x[0] is not None, x[0] or 0))
    ranks = defaultdict(list)
    for k, x in enumerate(able[:percent * len(able) // 100]):
        ranks[x].append(k + 1)
    return sorted(((*x, ranks[x].pop() if ranks[x] else None) for x in out), key=repr)


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling_equals_the_plain_version(spark, longest):
    rows = documents(4, 80) + [(800 + i, t) for i, t in enumerate(HARD)]
    target = ["w1 w2 w3 w4", "the w7 w9", None, "", "w1"]
    got = importance_resample(frame(spark, rows), spark.createDataFrame([(t,) for t in target], "text string"),
                              buckets=97, longest=longest, least_words=8, percent=30)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_resample(rows, target, 97, longest, 8, 30)


def test_resampling_of_empty_tables(spark):
    none = empty(spark)
    assert importance_resample(none, none).count() == 0
    rows = frame(spark, documents(1, 5))
    assert importance_resample(rows, none).count() == rows.count()


def test_packed_terms_count_like_a_counter():
    rng = random.Random(2)
    terms = [rng.choice("abcé") * rng.choice([1, 2, 4, 5, 8, 9, 15, 16, 17, 40, 70]) + rng.choice(["", "x", "yz"]) for _ in range(3000)]
    group, doc = [], []
    for i in range(len(terms)):
        doc.append(i // 50)
        group.append(doc[-1] % 3)
    raw = [t.encode() for t in terms]
    data = np.frombuffer(b"".join(raw), np.uint8)
    lengths = np.array([len(t) for t in raw])
    starts = np.cumsum(lengths) - lengths
    widths, found = width_of(lengths), {}
    assert all(w >= n for w, n in zip(widths, lengths, strict=True)) and set(widths[lengths <= PACKED]) == {4, 8, 16}
    for w in np.unique(widths):
        at = np.flatnonzero(widths == w)
        one = np.ones(len(at), np.int64)
        runs = run_count(packed(data, starts[at], lengths[at], int(w)), lengths[at], np.array(group)[at], one, one, np.array(doc)[at])
        for t, g, n, d in zip(strings(runs.keys, runs.lengths).to_pylist(), runs.group, runs.n, runs.docs, strict=True):
            found[t, int(g)] = int(n), int(d)
    want = Counter(zip(terms, group, strict=True))
    assert found == {k: (n, len({d for t, g, d in zip(terms, group, doc, strict=True) if (t, g) == k})) for k, n in want.items()}


def plain_divergence(rows, least, shown):
    counts, held, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        found = TERM.findall(lower(text))
        groups[lang or ""].add(source or "")
        counts[lang or "", source or ""].update(found)
        held[lang or ""].update(set(found))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in held[lang].items() if n >= least]
        total = {t: sum(counts[lang, s][t] for s in sources) for t in kept}

        def shares(count):
            n = sum(count[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (count[t] + 2) // (n + 2 * len(kept)) for t in kept}

        p, q = {s: shares(counts[lang, s]) for s in sources}, shares(total)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, shown)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]
                out |= {(lang, s, part, item, v, k + 1) for k, (v, item) in enumerate(ranked)}
    return out


def divergence_rows():
    rng = random.Random(8)
    rows = [(t, None if i % 11 == 0 else rng.choice(["en", "fr"]), None if i % 13 == 0 else f"s{rng.randrange(7)}")
            for i, (_, t) in enumerate(documents(6, 150))]
    long_words = " ".join(rng.choice(["commonlongterm" * k for k in range(1, 9)] + ["é" * 9, "zwölf"]) for _ in range(900))
    rows += [(long_words, "en", f"s{k}") for k in range(5)] + [(t, "xx", "alone") for t in HARD] + [(None, "yy", "a"), ("", "yy", "b")]
    return [("".join(chr(97 + int(c)) if c.isdigit() else c for c in t) if t else t, lang, s) for t, lang, s in rows]


def divergence_frame(spark, rows):
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, "text string, lang string, source string").select(
        "*", *(F.lit("clash").alias(c) for c in [*CLASHING, "term", "part", "item", "value", "no", "tile", "lead"])).repartition(3)


@pytest.mark.parametrize("tile, slice_rows, held, piece", [(512, 50_000, 3_000_000, 1 << 21), (3, 40, 50, 64)])
def test_divergence_equals_the_plain_version(spark, monkeypatch, tile, slice_rows, held, piece):
    for name, value in (("TILE", tile), ("SLICE_ROWS", slice_rows), ("HELD_RUNS", held), ("BLOCK_CELLS", 30)):
        monkeypatch.setattr(source_divergence, name, value)
    rows = divergence_rows()
    if piece != byte_words.PIECE:  # texts in many pieces
        counter = source_divergence.TermCounter()
        monkeypatch.setattr(source_divergence, "pieces", lambda column, inside: pieces(column, inside, size=piece))
        counter.add(pa.RecordBatch.from_pylist([{"text": t or "", "lang": a or "", "source": s or ""} for t, a, s in rows]))
        found = Counter()
        for batch in counter.send():
            for r in batch.to_pylist():
                found[r["lang"], r["source"], r["term"]] += r["docs"]
        assert found == Counter((a or "", s or "", w) for t, a, s in rows for w in set(TERM.findall(lower(t))))
    got = divergence(divergence_frame(spark, rows), least_docs=4, shown_terms=5)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    collected = list(map(tuple, got.collect()))
    assert len(collected) == len(set(collected)) and set(collected) == plain_divergence(rows, 4, 5)


def test_divergence_of_an_empty_table_and_large_counts(spark):
    assert divergence(empty(spark)).count() == 0
    big = spark.createDataFrame([(3 * 10**11, 7 * 10**11, 5)], "n long, own_n long, terms long")
    got = big.select(source_divergence.share("n", "own_n").alias("p")).first().p
    assert got == 1 + 10**9 * (3 * 10**11 + 2) // (7 * 10**11 + 10)


def test_automaton_gives_the_longest_match_at_every_token():
    rng = random.Random(3)
    for _ in range(40):
        texts = [[rng.randrange(3) for _ in range(rng.randrange(1, 12))] for _ in range(4)]
        a = SuffixAutomaton(texts)
        ends = defaultdict(set)
        for k, t in enumerate(texts):
            for i in range(len(t)):
                for j in range(i + 1, len(t) + 1):
                    ends[tuple(t[i:j])].add((k, j))
        read = [rng.randrange(4) for _ in range(60)]
        state = size = 0
        for i, token in enumerate(read):
            state, size = a.read(state, size, token)
            longest = next(n for n in range(i + 1, -1, -1) if not n or tuple(read[i + 1 - n:i + 1]) in ends)
            assert size == longest
            if size:
                assert set(a.ends[state]) == ends[tuple(read[i + 1 - size:i + 1])]


def plain_scan(text, templates, phrases, least, gap):
    """Base columns and the best share of a template, without automaton or window."""
    w = WORD.findall(lower(text))
    base = sorted((i, label) for p, label in phrases.items() for q in [p.split()] for i in range(len(w)) if w[i:i + len(q)] == q)
    best = 0.0
    known = [WORD.findall(lower(t)) for t in templates.values()] + [p.split() for p in phrases]
    runs = {tuple(t[i:j]) for t in known for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    most = max(map(len, runs))
    size = [max(n for n in range(min(most, i + 1) + 1) if not n or tuple(w[i + 1 - n:i + 1]) in runs) for i in range(len(w))]
    stops = [i for i, n in enumerate(size) if n >= least and (i + 1 == len(w) or size[i + 1] <= n)]
    for t in known[:len(templates)]:
        chains = []
        for i in stops:
            n = size[i]
            for e in range(n, len(t) + 1):
                if len(t) >= least and t[e - n:e] == w[i + 1 - n:i + 1]:
                    more = [c[2] + min(n, e - c[1], i + 1 - c[0]) for c in chains
                            if min(n, e - c[1], i + 1 - c[0]) > 0 and i + 1 - n - c[0] <= gap]
                    chains.append((i + 1, e, max([n, *more])))
                    best = max(best, chains[-1][2] / len(t))
    return (len(w), len(base), base[0][0] if base else None, base[-1][0] if base else None,
            ",".join(sorted({b for _, b in base})), 1.0 if base else best)


def licence_rows():
    rng = random.Random(1)
    rows = documents(7, 20) + [(800 + i, t) for i, t in enumerate(HARD)]
    for i, text in enumerate(TEMPLATES.values()):
        w = text.split()
        rows.append((1000 + i, "intro words\n" + text + "\nand more"))
        for _ in range(len(w) // 9):
            w[rng.randrange(len(w))] = "changed"
        rows.append((1100 + i, " ".join(w)))
        rows.append((1200 + i, " ".join(w[:len(w) // 4])))
    rows += [(1300, "The MIT License, the mit-license and MIT\nLICENSE; mit licenses"), (1301, "gnu general public general public license"),
             (1302, "Apache License " * 700), (1303, TEMPLATES["mit"] + " x " * 40 + TEMPLATES["bsd"] + " " + TEMPLATES["mit"])]
    return rows


def test_licence_scan_equals_the_plain_version(spark):
    rows = licence_rows()
    got = license_scan(frame(spark, rows))
    found = sorted(((r.doc_id, *r[1:6], r.score) for r in got.collect()), key=repr)
    assert found == sorted(((d, *plain_scan(t, TEMPLATES, PHRASES, 4, 12)) for d, t in rows), key=repr)


def test_licence_spans_cover_whole_and_edited_notices():
    notices = Notices(TEMPLATES, PHRASES, 4)
    for name, text in TEMPLATES.items():
        label = name.split(" ")[0]
        n_words = len(WORD.findall(lower(text)))
        spans = scan(f"a b c {text} d".encode(), notices)[7]
        assert {"label": label, "first_word": 3, "last_word": 2 + n_words, "share": 1.0} in spans
        assert label in scan(" ".join(text.split()).replace("the", "thee", 1).encode(), notices)[5].split(",")
    both = scan((TEMPLATES["isc"] + " filler" * 60 + " " + TEMPLATES["isc"]).encode(), notices)[7]
    assert [s["label"] for s in both] == ["isc", "isc"] and both[0]["last_word"] < both[1]["first_word"]
    clean = scan(b"the software is provided to the user and the copies of the document are in the folder", notices)
    assert clean[4:6] == ("", "") and clean[7] == []


def test_words_of_a_text_do_not_depend_on_pieces():
    text = " ".join(t or "" for _, t in documents(2, 6)).encode()
    assert [w for p in words(text, 5) for w in p] == [w for p in words(text) for w in p]


def test_licence_scan_of_an_empty_table(spark):
    assert license_scan(empty(spark)).count() == 0
