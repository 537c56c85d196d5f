"""Licence notices in texts, whole or edited.

All notices (templates) and phrases go into one generalised suffix automaton
of words. A text is streamed through it once: at every word the automaton
knows the longest run of words up to here that stands in some template. A
phrase stands where its state is met. Runs of ``least`` words and more that
the next word breaks off are anchors (a place in the text, a place in a
template); anchors in the same order on both sides, at most ``gap`` words
apart, are chained so that they cover as much of the template as they can. A
chain that covers ``share`` of its template is a span.

A text's state is the automaton's state and the anchors of the last window (a
template and a gap long), so memory does not grow with the text: texts of any
length are read whole, in pieces. Every row stands for itself; nothing is
shuffled.

Defined cases: a null or empty text has no words, places, labels or spans
(label columns are empty strings) and score 0; a null ``doc_id`` is carried
along; repeated rows each give a row; where two chains of a template overlap
the one that covers more stays, the earlier one on a tie; of several places
of a run in a template each is an anchor; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codecensus.llm.byte_words import buffers
from codecensus.llm.common import body, read
from codecensus.llm.licence_texts import PHRASES, TEMPLATES
from codecensus.llm.suffix_automaton import SuffixAutomaton

LEAST, GAP, SHARE = 4, 12, 0.5
PIECE = 1 << 20  # bytes
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

RESULT = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
          "score double, spans array<struct<label: string, first_word: long, last_word: long, share: double>>")


def words(text: bytes, piece: int = PIECE):
    """Lists of the lower-cased words of a text, a piece at a time."""
    at = 0
    while at < len(text):
        stop = at + piece
        while stop < len(text) and WORD.match(text[stop:stop + 1].lower()):
            stop += 1
        yield WORD.findall(text[at:stop].lower())  # bytes are lower-cased from A-Z only
        at = stop


class Notices:
    """The automaton of the templates and phrases and what its states mean.
    A template's label ends before the first space of its name."""

    def __init__(self, templates: dict[str, str], phrases: dict[str, str], least: int):
        def tokens(text):
            return WORD.findall(text.encode().lower())

        self.least = least
        self.labels = [name.split(" ")[0] for name in templates]
        texts = [tokens(t) for t in templates.values()]
        self.sizes = [len(t) for t in texts]
        known = [tokens(p) for p in phrases]
        self.automaton = a = SuffixAutomaton([*texts, *known])
        self.vocabulary = {w for t in (*texts, *known) for w in t}
        #: where strings of a state end in templates that are long enough
        self.places = [[(t, e) for t, e in ends if t < len(texts) and self.sizes[t] >= least] for ends in a.ends]
        whole = {a.state_of(p): (len(p), label) for p, label in zip(known, phrases.values(), strict=True)}
        #: phrases that end where a state is met with a match as long as they
        self.phrases = [[whole[s] for s in a.suffixes(v) if s in whole] for v in range(len(a.next))]
        self.longest = max([0, *self.sizes])


class Chains:
    """Chains of the anchors of one text, fed by their ends in the text."""

    def __init__(self, notices: Notices, gap: int, share: float):
        self.of, self.gap, self.share = notices, gap, share
        self.open: list[deque] = [deque() for _ in notices.sizes]
        self.spans: list[list] = [[] for _ in notices.sizes]
        self.best = 0.0

    def anchor(self, t: int, stop: int, end: int, size: int) -> None:
        """``size`` words before ``stop`` in the text equal those before
        ``end`` in template ``t``."""
        chains, begin = self.open[t], stop - size
        while chains and chains[0]["stop"] < begin - self.of.longest - self.gap:
            self._close(t, chains.popleft())
        covered, first, last = size, begin, None
        for c in chains:
            more = min(size, end - c["end"], stop - c["stop"])
            if more > 0 and begin - c["stop"] <= self.gap and c["covered"] + more > covered:
                covered, first, last = c["covered"] + more, c["first"], c
        if last:
            last["used"] = True
        chains.append({"stop": stop, "end": end, "covered": covered, "first": first, "used": False})
        self.best = max(self.best, covered / self.of.sizes[t])

    def _close(self, t: int, c: dict) -> None:
        share = c["covered"] / self.of.sizes[t]
        if c["used"] or share < self.share:
            return
        found = self.spans[t]
        if found and c["first"] < found[-1][1]:  # overlaps
            if share <= found[-1][2]:
                return
            found.pop()
        found.append((c["first"], c["stop"], share))

    def close(self) -> list[dict]:
        for t, chains in enumerate(self.open):
            while chains:
                self._close(t, chains.popleft())
        return sorted(({"label": self.of.labels[t], "first_word": first, "last_word": stop - 1, "share": share}
                       for t, found in enumerate(self.spans) for first, stop, share in found),
                      key=lambda s: (s["first_word"], s["last_word"], s["label"]))


def scan(text: bytes, notices: Notices, gap: int = GAP, share: float = SHARE) -> tuple:
    """n_words, n_base, first and last place, base labels, labels, score, spans."""
    a, least, places, phrases = notices.automaton, notices.least, notices.places, notices.phrases
    known, step = notices.vocabulary, a.read
    chains, labels = Chains(notices, gap, share), set()
    state = matched = at = n_base = 0
    first = last = None

    def break_off() -> None:
        if matched >= least:
            for t, end in places[state]:
                chains.anchor(t, at, end, matched)

    for found in words(text):
        for word in found:
            if word not in known:
                if matched:
                    break_off()
                    state = matched = 0
                at += 1
                continue
            new, longer = step(state, matched, word)
            if longer <= matched:
                break_off()
            state, matched = new, longer
            at += 1
            for size, label in phrases[state]:
                if size <= matched:
                    n_base += 1
                    labels.add(label)
                    begin = at - size
                    first = begin if first is None else min(first, begin)
                    last = begin if last is None else max(last, begin)
    break_off()
    spans = chains.close()
    return (at, n_base, first, last, ",".join(sorted(labels)), ",".join(sorted(labels | {s["label"] for s in spans})),
            1.0 if n_base else chains.best, spans)


def license_scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES,
                 least: int = LEAST, gap: int = GAP, share: float = SHARE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score and spans of every whole text.

    ``n_base`` counts the places of all phrases, ``first_word`` and
    ``last_word`` are the smallest and largest of their starts. ``labels``
    adds those of the spans. ``score`` is 1 where a phrase stands, else the
    greatest share of a template that one chain covers. ``spans`` lists the
    covered template spans in the text's order."""

    def run(batches):
        notices = Notices(templates, phrases, least)
        for batch in batches:
            offsets, data = buffers(batch.column("text"))
            rows = [scan(data[i:j].tobytes(), notices, gap, share) for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
            columns = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), spans]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, columns, kinds)], names=names)

    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    spans = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()),
                                ("share", pa.float64())]))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), body().alias("text")).mapInArrow(run, RESULT)


def op13_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(read(spark, sf_dir, "documents"))
