"""Token ids of whole texts, with distinct words encoded once.

A byte-level BPE tokenizer first splits a text into words by a fixed pattern and then encodes each word on
its own. Here the split is done on arrays for many texts at once, distinct words are encoded by the
tokenizer itself, and their ids are kept by a 64-bit hash of the word.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np

from jobloom.llm.textvec import mix, powers_of_step

SPACE, LETTER, NUMBER, OTHER, UNKNOWN = range(5)
#: Texts are split in slices of about this many characters.
SLICE_CHARS = 400_000
#: Words kept by a Python worker; beyond that it starts anew.
MAX_WORDS = 2_000_000

_kinds: np.ndarray | None = None
_loaded: dict[str, WordTokenizer] = {}


def _character_kinds() -> np.ndarray:
    global _kinds
    if _kinds is None:
        kinds = np.full(0x110000, OTHER, dtype=np.uint8)
        for code in range(0x110000):
            category = unicodedata.category(chr(code))
            if category[0] == "L":
                kinds[code] = LETTER
            elif category[0] == "N":
                kinds[code] = NUMBER
            elif category == "Cn":  # a newer Unicode may know it: left to the tokenizer
                kinds[code] = UNKNOWN
        white = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B)]
        kinds[[*white, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
        _kinds = kinds
    return _kinds


def _byte_letters() -> dict[int, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [byte for byte in range(256) if byte not in shown]
    return {byte: byte for byte in shown} | {byte: 256 + k for k, byte in enumerate(hidden)}


def forget() -> None:
    """Drop the tokenizers of this Python worker and the words that they have met."""
    global _kinds
    _loaded.clear()
    _kinds = None


def word_starts(codes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Where words begin: ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.

    ``text`` has the offsets of the texts; every non-empty text begins a word.
    """
    n = len(codes)
    kind = _character_kinds()[codes]
    space = kind == SPACE
    new_text = np.zeros(n + 1, dtype=bool)
    new_text[text] = True
    run = np.ones(n + 1, dtype=bool)
    run[1:n] = kind[1:] != kind[:-1]
    run |= new_text
    blank = codes == 0x20
    starts = run[:n].copy()
    attached = starts & ~space & ~new_text[:n]
    attached[1:] &= blank[:-1]
    attached[:1] = False
    starts &= ~attached  # such a run begins with the blank before it
    last = space & run[1:] & ~new_text[1:]  # the last white space before a word
    starts |= last
    quote = np.flatnonzero((codes == 0x27) & starts & run[1:] & ~new_text[1:])
    for at in quote[kind[quote + 1] == LETTER] if len(quote) else ():
        one = chr(codes[at + 1])
        two = one + chr(codes[at + 2]) if at + 2 < n and not new_text[at + 2] else one
        size = 2 if two in ("re", "ve", "ll") else 1 if one in "stmd" else 0
        if size:
            starts[at + 1] = False
            if at + 1 + size < n:
                starts[at + 1 + size] = True
    return np.flatnonzero(starts)


class WordTokenizer:
    """Ids by the tokenizer file at ``path``, equal to ``encode(text, add_special_tokens=False).ids``."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    @classmethod
    def at(cls, path: str) -> WordTokenizer:
        """The tokenizer of this Python worker, with the words that it has met."""
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    def _forget(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)
        self.first = np.zeros(0, dtype=np.int64)
        self.size = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.uint32)

    def _plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        """Add words, in the order of their keys."""
        if len(self.keys) + len(keys) > MAX_WORDS:
            self._forget()
        encode, letters = self.tokenizer.model.tokenize, _byte_letters()
        ids = [[x.id for x in encode(w.encode().decode("latin-1").translate(letters))] for w in words]
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        first = len(self.ids) + np.concatenate(([0], np.cumsum(size)[:-1]))
        self.ids = np.concatenate([self.ids, np.fromiter((y for x in ids for y in x), dtype=np.uint32)])
        at = np.searchsorted(self.keys, keys)
        self.first = np.insert(self.first, at, first)
        self.size = np.insert(self.size, at, size)
        self.keys = np.insert(self.keys, at, keys)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        i = 0
        while i < len(texts):
            j, chars = i + 1, len(texts[i])
            while j < len(texts) and chars + len(texts[j]) <= SLICE_CHARS:
                chars += len(texts[j])
                j += 1
            out += self._encode(texts[i:j])
            i = j
        return out

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        special = {k for k, s in enumerate(texts) if any(token in s for token in self.added)}
        whole = "".join("" if k in special else s for k, s in enumerate(texts))
        text = np.cumsum([0, *(0 if k in special else len(s) for k, s in enumerate(texts))])
        codes = np.frombuffer(whole.encode("utf-32-le"), dtype=np.uint32)
        unknown = np.flatnonzero(_character_kinds()[codes] == UNKNOWN) if len(codes) else []
        if len(unknown):
            special |= set((np.searchsorted(text, unknown, side="right") - 1).tolist())
        begin = word_starts(codes, text) if len(codes) else np.zeros(0, dtype=np.int64)
        if len(begin):
            end = np.concatenate((begin[1:], [len(codes)]))
            length = end - begin
            place = np.arange(len(codes)) - np.repeat(begin, length)
            value = (codes + np.uint64(1)) * np.uint64(0xA24BAED4963EE407)
            value ^= value >> np.uint64(29)
            powers = powers_of_step(int(length.max()))
            hashed = mix(np.add.reduceat(value * powers[place], begin) + length.astype(np.uint64))
            keys, at, back = np.unique(hashed, return_index=True, return_inverse=True)
            found = np.searchsorted(self.keys, keys)
            new = np.ones(len(keys), dtype=bool)
            inside = found < len(self.keys)
            new[inside] = self.keys[found[inside]] != keys[inside]
            if new.any():
                if len(self.keys) + int(new.sum()) > MAX_WORDS:
                    self._forget()
                    new[:] = True
                self._learn(keys[new], [whole[a:b] for a, b in zip(begin[at[new]], end[at[new]], strict=True)])
                found = np.searchsorted(self.keys, keys)
            first, size = self.first[found][back], self.size[found][back]
            to = np.concatenate(([0], np.cumsum(size)))
            ids = self.ids[np.arange(to[-1]) - np.repeat(to[:-1] - first, size)]
            cut = to[np.searchsorted(begin, text)]
        else:
            ids, cut = np.zeros(0, dtype=np.uint32), np.zeros(len(texts) + 1, dtype=np.int64)
        return [self._plain(s) if k in special else ids[cut[k] : cut[k + 1]] for k, s in enumerate(texts)]
