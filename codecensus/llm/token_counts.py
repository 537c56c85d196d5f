"""Token counts by a linear longest-match automaton.

Greedy longest-match splitting takes the longest vocabulary piece at the
front of a word again and again. The automaton is the trie of the pieces;
each node has a failure link (the node for what is left of its string after
the greedy pieces that are certain by then have been popped) and the number
of these pieces. Reading a word letter by letter, following failure links and
adding up their counts gives the number of its pieces in time linear in its
length; no piece is ever built.

Words are split and lower-cased as the vocabulary file declares; a word that
the pieces can't spell counts as one unknown token, like every added token.

Defined cases: a null or empty text has no words and no tokens; a null
``doc_id`` is carried along; repeated rows each give a row; an empty table
gives no rows; other columns are ignored; a text of any length is counted
whole.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codecensus.llm.bpe_codec import default_tokenizer
from codecensus.llm.common import body, read
from codecensus.llm.wordsplit import Splitter, byte_letters, load

CACHED_WORDS, CACHED_LENGTH = 400_000, 64
_WORKER: dict[str, tuple] = {}  # what a Python worker keeps from task to task


class LongestMatch:
    """Pieces are sequences of symbols (any hashable values)."""

    def __init__(self, pieces):
        self.next: list[dict] = [{}]
        whole = [False]
        for piece in pieces:
            node = 0
            for c in piece:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    whole.append(False)
                node = self.next[node][c]
            whole[node] = node > 0
        self.fail, self.pops = [-1] * len(self.next), [0] * len(self.next)
        layer = [0]
        while layer:  # in breadth, so that links of shorter strings exist
            deeper = []
            for u in layer:
                for c, v in self.next[u].items():
                    deeper.append(v)
                    if whole[v]:
                        self.fail[v], self.pops[v] = 0, 1
                        continue
                    z, n = self.fail[u], self.pops[u]
                    while z >= 0 and c not in self.next[z]:
                        n += self.pops[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[v], self.pops[v] = self.next[z][c], n
            layer = deeper

    def count(self, symbols) -> int:
        """Number of greedy pieces, or -1 if the word can't be spelt."""
        nxt, fail, pops = self.next, self.fail, self.pops
        u = n = 0
        for c in symbols:
            while c not in nxt[u]:
                n += pops[u]
                u = fail[u]
                if u < 0:
                    return -1
            u = nxt[u][c]
        while u > 0:
            n += pops[u]
            u = fail[u]
        return n if u == 0 else -1


def _pieces(spec: dict):
    """Vocabulary entries as byte symbols; 256 and up: a byte that ends its word."""
    byte = {c: b for b, c in enumerate(byte_letters())}
    for token in spec["vocab"]:
        last = token.endswith(spec["end"]) and len(token) > len(spec["end"])
        symbols = [byte[c] for c in (token[: -len(spec["end"])] if last else token)]
        if last:
            symbols[-1] += 256
        yield symbols


def word_symbols(word: str) -> list[int]:
    symbols = list(word.encode("utf-8"))
    symbols[-1] += 256
    return symbols


def token_counts(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, n_bytes, n_words, n_tokens, n_unknown of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(load(vocabulary_path))  # the size of the vocabulary file

    def run(batches):
        if vocabulary_path not in _WORKER:
            _WORKER.clear()
            spec = sent.value
            _WORKER[vocabulary_path] = LongestMatch(_pieces(spec)), Splitter(spec["pattern"], spec["added"]), {}
        automaton, splitter, cache = _WORKER[vocabulary_path]

        def count(w: str) -> int:
            n = automaton.count(word_symbols(w))
            if len(w) <= CACHED_LENGTH:
                if len(cache) >= CACHED_WORDS:
                    cache.clear()
                cache[w] = n
            return n

        for batch in batches:
            rows = []
            for text in (x.as_py() for x in batch.column("text")):
                n_words = n_tokens = unknown = 0
                for k, section in enumerate(splitter.sections(text)):
                    if k % 2:
                        n_tokens += 1
                        continue
                    found = splitter.words(section)
                    counts = [cache.get(w) or count(w) for w in found]
                    n_words += len(found)
                    lost = counts.count(-1)
                    unknown += lost
                    n_tokens += sum(counts) + 2 * lost
                rows.append((n_words, n_tokens, unknown))
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, pa.int64()) for c in columns)],
                names=["doc_id", "n_bytes", "n_words", "n_tokens", "n_unknown"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), body().alias("text"),
                       F.octet_length(body()).cast("long").alias("n_bytes")).mapInArrow(
        run, "doc_id long, n_bytes long, n_words long, n_tokens long, n_unknown long")


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"), default_tokenizer())
