"""BPE encoding and decoding by a compiled tokenization automaton.

The automaton starts with one arc per base symbol from every state. The
merges are compiled in, one after the other: the gadget of merge (u, v) -> uv

* adds an arc uv from every state that (still) has an arc u after the
  gadget; its target starts as a copy of the target of v, and
* takes the arc v away from the target of u.

What is left spells every word in exactly one way, its BPE encoding. A state
is named by the token whose arc leads to it, so the removals are kept once,
where they happened: a copied state (or arc) sees those of the state (arc) it
was copied from up to the moment of copying, and its own after that.

A word is encoded left to right by table look-ups: from each position that
has been reached, the trie of arc labels gives the arcs that can be read, and
the removals say which of them leave the state. Every position is reached by
exactly one arc, so the path is found without search; its labels' ids are the
encoding. Decoding emits the labels of the ids.

Defined cases: a null text is an empty text and has no ids; a null ``doc_id``
is carried along; repeated rows each give a row; texts of any length are
encoded whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codecensus.llm.common import body, lists, read
from codecensus.llm.wordsplit import Splitter, byte_letters, load

CACHED_WORDS, CACHED_LENGTH = 150_000, 64  # bounds a worker's memory; other words are encoded each time
ROWS = 512  # rows that are turned at once


class MergeAutomaton:
    def __init__(self, spec: dict):
        self.vocab, self.end = spec["vocab"], spec["end"]
        size = max(self.vocab.values()) + 1
        self.left, self.right, self.born = [-1] * size, [-1] * size, [-1] * size
        self.cut: list[dict[int, int]] = [{} for _ in range(size)]  # of a state: arc -> merge that took it away
        self.spell: list[tuple[int, ...]] = [()] * size
        letters = byte_letters()
        self.plain = [self.vocab[c] for c in letters]
        self.final = [self.vocab[c + self.end] for c in letters]
        for base in (*self.plain, *self.final):
            self.spell[base] = (base,)
        for k, (u, v) in enumerate(spec["merges"]):
            self._gadget(k, self.vocab[u], self.vocab[v], self.vocab[u + v])
        self.trie: list[dict[int, int]] = [{}]
        self.arc: list[int] = [-1]
        for token, symbols in enumerate(self.spell):
            if symbols:
                self._insert(token, symbols)
        self.known: dict[int, bool] = {}

    def _gadget(self, k: int, u: int, v: int, uv: int) -> None:
        if self.spell[uv]:
            raise ValueError("two merges make the same token")
        if not (self.spell[u] and self.spell[v] and self._has_arc(u, v)):
            return  # no path reads u and then v, so the merge never happens
        self.left[uv], self.right[uv], self.born[uv] = u, v, k
        self.spell[uv] = self.spell[u] + self.spell[v]
        self.cut[u][v] = k

    def _insert(self, token: int, symbols: tuple[int, ...]) -> None:
        node = 0
        for s in symbols:
            nxt = self.trie[node].get(s)
            if nxt is None:
                nxt = self.trie[node][s] = len(self.trie)
                self.trie.append({})
                self.arc.append(-1)
            node = nxt
        self.arc[node] = token

    def has_arc(self, state: int, token: int) -> bool:
        """Whether the state reached by ``state`` has an arc ``token``."""
        key = state << 32 | token
        found = self.known.get(key)
        if found is None:
            if len(self.known) > 2_000_000:
                self.known.clear()
            found = self.known[key] = self._has_arc(state, token)
        return found

    def _has_arc(self, state: int, token: int) -> bool:
        born, left, right = self.born, self.left, self.right
        arcs, y, until = [], token, len(self.born)
        while y >= 0:  # the arcs that this one was copied from, and up to which merge (that one included)
            arcs.append((y, until))
            until, y = born[y], left[y]
        x, until = state, len(self.born)
        while x >= 0:  # the states that this one was copied from, and before which merge
            cut = self.cut[x]
            if cut:
                for y, last in arcs:
                    k = cut.get(y)
                    if k is not None and k < until and k <= last:
                        return False
            until, x = born[x], right[x]
        return True

    def encode(self, word: str) -> list[int]:
        raw = word.encode("utf-8")
        symbols = [self.plain[b] for b in raw[:-1]]
        symbols.append(self.final[raw[-1]])
        n = len(symbols)
        came, at = [-1] * (n + 1), [0] * (n + 1)
        trie, arc, known, has = self.trie, self.arc, self.known, self.has_arc
        for j in range(n):
            state = came[j]
            if j and state < 0:
                continue
            node, i = 0, j
            for s in symbols[j:] if j else symbols:
                node = trie[node].get(s)
                if node is None:
                    break
                i += 1
                token = arc[node]
                if token >= 0 and came[i] < 0:
                    if j:
                        fits = known.get(state << 32 | token)
                        if not (has(state, token) if fits is None else fits):
                            continue
                    came[i], at[i] = token, j
        out, i = [], n
        while i:
            out.append(came[i])
            i = at[i]
        out.reverse()
        return out


_ENCODERS: dict[str, "Encoder"] = {}


class Encoder:
    """Whole texts to ids; a Python worker keeps one from task to task."""

    @classmethod
    def of(cls, path: str, spec: dict) -> "Encoder":
        if path not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[path] = cls(MergeAutomaton(spec), Splitter(spec["pattern"], spec["added"]), spec["added"])
        return _ENCODERS[path]

    def __init__(self, automaton: MergeAutomaton, splitter: Splitter, added: dict[str, int]):
        self.automaton, self.splitter, self.added = automaton, splitter, added
        self.cache: dict[str, bytes] = {}

    def word(self, w: str) -> bytes:
        ids = np.array(self.automaton.encode(w), np.int32).tobytes()
        if len(w) <= CACHED_LENGTH:
            if len(self.cache) >= CACHED_WORDS:
                self.cache.clear()
            self.cache[w] = ids
        return ids

    def text(self, text: str) -> bytes:
        out = []
        get, word = self.cache.get, self.word
        for k, section in enumerate(self.splitter.sections(text)):
            if k % 2:
                out.append(np.int32(self.added[section]).tobytes())
            elif section:
                out += [get(w) or word(w) for w in self.splitter.words(section)]
        return b"".join(out)


def encode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, ids array<int>) of every whole text."""
    spec = load(tokenizer_path)
    sent = docs.sparkSession.sparkContext.broadcast(spec)  # the size of the vocabulary file

    def run(batches):
        encoder = Encoder.of(tokenizer_path, sent.value)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                parts = [encoder.text(t) for t in batch.column("text").to_pylist()]
                ends = np.cumsum([0, *(len(p) // 4 for p in parts)], dtype=np.int32)
                flat = np.frombuffer(b"".join(parts), np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), body().alias("text")).mapInArrow(
        run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, ids, text): the arc labels of the ids, a space between."""
    spec = load(tokenizer_path)
    names = {i: t for t, i in (spec["vocab"] | spec["added"]).items()}
    sent = encoded.sparkSession.sparkContext.broadcast([names.get(i, "") for i in range(max(names) + 1)])

    def run(batches):
        labels = pa.array(sent.value, pa.string())
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                flat, ends = lists(batch.column("ids"))
                arcs = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), labels.take(pa.array(flat)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pc.binary_join(arcs, " ")],
                                                 names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def codec_digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decode(encode(docs, tokenizer_path), tokenizer_path).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"))


def op9_bpe_codec(spark, sf_dir: str) -> DataFrame:
    return codec_digests(read(spark, sf_dir, "documents"), default_tokenizer())
