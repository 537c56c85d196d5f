"""Normalising and splitting text the way a word-level BPE file declares it:
NFC, white space runs to one space, lower case, then the split pattern."""

from __future__ import annotations

import json
import re
import unicodedata

import regex


def load(path: str) -> dict:
    """The tokenizer file at ``path``: vocabulary, merges, added tokens and
    the split pattern."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
    return {"vocab": spec["model"]["vocab"], "merges": [tuple(m) for m in spec["model"]["merges"]],
            "end": spec["model"]["end_of_word_suffix"], "pattern": pattern,
            "added": {t["content"]: t["id"] for t in spec["added_tokens"]}}


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level files:
    printable Latin-1 bytes stand for themselves, the others for the letters
    from U+0100 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    letter = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [letter[b] for b in range(256)]


class Splitter:
    """Words of whole texts. The pattern takes no white space, so runs of it
    need not become one space first."""

    def __init__(self, pattern: str, added: dict[str, int]):
        self.find = regex.compile(pattern).findall
        # the same pattern where letters and digits are ASCII
        plain = pattern.replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9").replace(r"\s", r" \t\n\r\f\v")
        self.find_plain = re.compile(plain, re.A).findall
        names = sorted(added, key=len, reverse=True)
        self.names = names
        self.added = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None

    def sections(self, text: str) -> list[str]:
        """Added tokens are cut out of the text as it stands; they are the
        odd items."""
        return self.added.split(text) if any(n in text for n in self.names) else [text]

    def words(self, section: str) -> list[str]:
        if section.isascii():
            return self.find_plain(section.lower())
        if not unicodedata.is_normalized("NFC", section):
            section = unicodedata.normalize("NFC", section)
        # letter by letter, so a capital sigma never becomes a final one
        return self.find(section.replace("Σ", "σ").lower())
