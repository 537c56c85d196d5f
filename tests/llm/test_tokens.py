import hashlib
import random
from collections import Counter

import pytest

pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from codecensus.llm.bpe_codec import MergeAutomaton, codec_digests, decode, default_tokenizer, encode  # noqa: E402
from codecensus.llm.token_counts import LongestMatch, _pieces, token_counts, word_symbols  # noqa: E402
from codecensus.llm.wordsplit import Splitter, load  # noqa: E402
from llm_fixtures import documents, empty, frame  # noqa: E402

PATH = default_tokenizer()
HARD = ["Hello  World's 123 <|endoftext|> ñ ΣΑΣ  x​İ", "don't!!! 'S 'ſ", "<|startoftext|><|endoftext|", "été",
        "中文字 😀😀", "a\x0bb\x85c　d", "".join(chr(c) for c in range(1, 256)), "aaaaaaaaaaaaaaaaaaab" * 30]


def test_codec_equals_the_library(spark):
    rng = random.Random(2)
    rows = documents() + [(1000 + i, t) for i, t in enumerate(HARD)]
    rows += [(2000 + i, "".join(rng.choice(["th", "e", "in", "g", "er", "s", "'s", "ion", " ", "a", "b"]) for _ in range(40)))
             for i in range(100)]
    library = tokenizers.Tokenizer.from_file(PATH)
    want = Counter()
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want[d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
             hashlib.sha256(text.encode()).hexdigest()] += 1
    assert Counter(map(tuple, codec_digests(frame(spark, rows), PATH).collect())) == want


def test_codec_empty(spark):
    assert decode(encode(empty(spark), PATH), PATH).count() == 0


def test_automaton_small():
    """Overlapping merges of one letter, against merging by rank."""
    merges = [("a", "a"), ("aa", "a</w>"), ("b", "a"), ("aa", "aa"), ("ba", "aa")]
    from codecensus.llm.wordsplit import byte_letters

    names = [*byte_letters(), *(c + "</w>" for c in byte_letters()), *(u + v for u, v in merges)]
    vocab = {t: i for i, t in enumerate(names)}
    automaton = MergeAutomaton({"vocab": vocab, "merges": merges, "end": "</w>"})

    def plain(word):
        parts = [*word[:-1], word[-1] + "</w>"]
        for u, v in merges:
            i = 0
            while i < len(parts) - 1:
                if (parts[i], parts[i + 1]) == (u, v):
                    parts[i:i + 2] = [u + v]
                i += 1
        return [vocab[p] for p in parts]

    for n in range(1, 11):
        for bits in range(2**n):
            word = "".join("ab"[bits >> k & 1] for k in range(n))
            assert automaton.encode(word) == plain(word), word


def greedy(symbols, pieces):
    n = at = 0
    while at < len(symbols):
        for to in range(len(symbols), at, -1):
            if tuple(symbols[at:to]) in pieces:
                break
        else:
            return -1
        n, at = n + 1, to
    return n


def test_longest_match_small():
    pieces = [tuple(p) for p in ("a", "ab", "abc", "bcd", "cde", "d", "xx")]
    automaton = LongestMatch(pieces)
    rng = random.Random(3)
    for _ in range(3000):
        word = "".join(rng.choice("abcdex") for _ in range(rng.randrange(1, 9)))
        assert automaton.count(word) == greedy(word, set(pieces)), word


def test_token_counts(spark):
    rows = documents() + [(1000 + i, t) for i, t in enumerate(HARD)]
    spec = load(PATH)
    pieces, splitter = {tuple(p) for p in _pieces(spec)}, Splitter(spec["pattern"], spec["added"])
    want = Counter()
    for d, t in rows:
        sections = splitter.sections(t or "")
        found = [w for s in sections[::2] for w in splitter.words(s)]
        counts = [greedy(word_symbols(w), pieces) for w in found]
        n = sum(1 if c < 0 else c for c in counts) + len(sections[1::2])
        want[d, len((t or "").encode()), len(found), n, sum(c < 0 for c in counts)] += 1
    assert Counter(map(tuple, token_counts(frame(spark, rows), PATH).collect())) == want
    assert token_counts(empty(spark), PATH).count() == 0
