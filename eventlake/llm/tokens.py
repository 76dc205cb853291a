"""Token ids of whole texts with a cache of words.

This holds for tokenizers that normalise and split as ``_NORMALIZER`` and ``_SPLIT`` say, which is
looked up in the file; texts are given whole to any other one.  Such a tokenizer splits at white
space before anything else and never joins across it, so the ids of a text are the ids of its space-separated parts, one after another.  Parts recur; each worker
encodes a part once and keeps its ids as little-endian 32-bit bytes.  Case is ignored, and letters
and the punctuation after them are pieces of their own, so Latin texts are lower-cased and their
commas and full stops set apart first, and other parts share the entry of their letters.  New words
are encoded together, and the marks of word ends tell them apart.  The cache is emptied when it is
full, so its memory is bounded.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

_LONGEST_KEY = 64
# What a tokenizer file says if it lower-cases, drops white space and sets letters, digits and signs apart.
_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = {
    "type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True,
}
_JOINED = re.compile(r"[^a-z0-9ß-öø-ÿ \n][.,](?=[ \n]|$)")  # a stop that is one piece with what stands before it
_PLAIN = re.compile(r"([a-zß-öø-ÿ]+)([!-/:-@\[-`{-~]*)")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """Encodes texts, by their words where the tokenizer lets pieces never span white space."""

    def __init__(self, path: str, literal_specials: bool = False, entries: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = literal_specials
        self._specials = [t.content.lower() for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._entries = entries
        self._cache: dict[str, bytes] = {}
        told = json.loads(self._tokenizer.to_str())
        splits = (told.get("pre_tokenizer") or {}).get("pretokenizers") or [None]
        self.by_words = (told.get("normalizer") or {}).get("normalizers") == _NORMALIZER and splits[0] == _SPLIT
        mark = told["model"].get("end_of_word_suffix")
        self._ends = np.zeros(self.vocabulary, bool)
        for piece, id_ in self._tokenizer.get_vocab(with_added_tokens=False).items() if mark else ():
            self._ends[id_] = piece.endswith(mark)

    def encode(self, text: str | None) -> bytes:
        """The ids of ``text`` as little-endian unsigned 32-bit numbers; null and empty have none."""
        if not self.by_words:
            return np.array(self._tokenizer.encode(text or "", add_special_tokens=False).ids, dtype="<u4").tobytes()
        parts = self._apart(text or "").replace("\n", " ").split(" ")
        try:
            return b"".join(map(self._cache.__getitem__, parts))
        except KeyError:
            if len(self._cache) > self._entries:
                self._cache.clear()
            extra = self._learn(set(parts).difference(self._cache))
            known = self._cache
            return b"".join([known[p] if p in known else extra[p] for p in parts])

    def _apart(self, text: str) -> str:
        """A Latin text in lower case with spaces before the stops at word ends; other texts as they are."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
        low = text.lower()
        if any(x in low for x in self._specials):  # these are told by case
            return text
        if _JOINED.search(low):
            return low
        for stop in ".,":
            low = low.replace(f"{stop} ", f" {stop} ").replace(f"{stop}\n", f" {stop}\n")
        return f"{low[:-1]} {low[-1]}" if low.endswith((".", ",")) else low

    def _learn(self, new: set[str]) -> dict[str, bytes]:
        """Puts new parts into the cache; those too long for it are returned."""
        cache, extra, plain, odd, needed = self._cache, {}, [], [], {}
        for part in new:
            found = _PLAIN.fullmatch(part.lower()) if len(part) <= _LONGEST_KEY else None
            if found is None:
                odd.append(part)
                continue
            plain.append((part, found[1], found[2]))
            for piece in found.groups():
                if piece and piece not in cache:
                    needed[piece] = None
        words = [w for w in needed if w[0].isalpha()]
        if words and self._ends.any():
            ids = np.array(self._tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self._ends[ids]) + 1
            if len(cuts) == len(words):
                data, at = ids.tobytes(), 0
                for word, end in zip(words, (4 * cuts).tolist(), strict=True):
                    cache[word] = data[at:end]
                    at = end
        odd += [w for w in needed if w not in cache]
        for part, got in zip(odd, self._tokenizer.encode_batch_fast(odd, add_special_tokens=False), strict=True):
            (cache if len(part) <= _LONGEST_KEY else extra)[part] = np.array(got.ids, dtype="<u4").tobytes()
        for part, word, rest in plain:
            cache[part] = cache[word] + (cache[rest] if rest else b"")
        return extra

    @property
    def vocabulary(self) -> int:
        return self._tokenizer.get_vocab_size(with_added_tokens=True)


@lru_cache(4)
def tokenizer(path: str, literal_specials: bool = False, entries: int = 800_000) -> WordTokenizer:
    """One per Python worker and file."""
    return WordTokenizer(path, literal_specials, entries)
