"""Token ids of a public word-level BPE tokenizer, encoded word by word with a cache bounded in bytes.

The tokenizer's rules cut at white space first, so the ids of a text are the ids of its words, end to end; a word in turn is
cut by the tokenizer's own pattern. Both steps are cached. A word with a special token or with characters beyond the common
scripts is left to the tokenizer itself.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from array import array

import regex
from tokenizers import Tokenizer


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the tokenizer's file lies on this machine; every executor has the same package."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level BPE writes for each byte: printable ones stand for themselves, others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def _packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Encoder:
    """`encode(text)` → ids as little-endian unsigned 32-bit bytes, as the tokenizer itself gives without special tokens."""

    def __init__(self, path: str, cache_bytes: int = 128 << 20):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cuts = [p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        norms = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if len(cuts) != 1 or norms != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("this encoder is for tokenizers that lower-case and cut words at white space")
        self.pattern = regex.compile(cuts[0]["pattern"]["Regex"])
        if not all(t["content"].startswith("<|") for t in spec["added_tokens"]):
            raise ValueError("special tokens are told by their first two characters")
        self.letters, self.model = _byte_letters(), self.tokenizer.model
        self.room = self.half = cache_bytes // 2
        self.words: dict[str, bytes] = {}  # of words since the cache was last turned over, and of those before
        self.old_words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.old_parts: dict[str, bytes] = {}

    def _spelled(self, part: str) -> bytes:
        return _packed([t.id for t in self.model.tokenize(part.encode("utf-8").decode("latin-1").translate(self.letters))])

    def _part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            found = self.parts[part] = self.old_parts.get(part) or self._spelled(part)
            self.room -= _ENTRY + len(part) + len(found)
        return found

    def _word(self, word: str) -> bytes:
        found = self.old_words.get(word)
        if found is None:
            if word.isascii() and word.isalpha():
                found = self._spelled(word.lower())
            elif "<|" not in word and _PLAIN.fullmatch(word):
                found = b"".join(map(self._part, self.pattern.findall(unicodedata.normalize("NFC", word).lower())))
            else:
                found = _packed(self.tokenizer.encode(word, add_special_tokens=False).ids)
        self.words[word] = found
        self.room -= _ENTRY + len(word) + len(found)
        return found

    def encode(self, text: str) -> bytes:
        """The cache is turned over when half of it is full: what was used since then stays, the rest goes at the next turn."""
        if self.room < 0:
            self.old_words, self.old_parts, self.words, self.parts, self.room = self.words, self.parts, {}, {}, self.half
        known, out = self.words, []
        for word in _CHUNK.findall(text) if _OTHER_SPACE.search(text) else text.split():
            found = known.get(word)
            out.append(self._word(word) if found is None else found)
        return b"".join(out)


_ENTRY = 180  # bytes of a cache entry besides its texts: two objects' heads and a place in the table
_CHUNK = re.compile(r"[^ \t\n\r\f\v]+")
#: White space that libraries don't agree on; it then stays inside a word, for the tokenizer to judge.
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Words of these characters are lower-cased, composed and cut alike everywhere: Latin, Cyrillic, common punctuation, kana, Han.
_PLAIN = re.compile("[\x21-\x7e\xa1-\xac\xae-\u012f\u0131-\u024f\u0400-\u0481\u048a-\u052f\u2010-\u2027\u2030-\u205e\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5]+")
