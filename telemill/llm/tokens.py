"""Exact token ids of whole texts by the tokenizers library, every distinct word encoded once per worker.

A text is cut where its tokenizer always cuts, so that the parts can be encoded apart: see ``cuts``. Texts holding the
string of a special token go to the library whole.
"""

from __future__ import annotations

import itertools
import json
import os
import re

import numpy as np

from telemill.llm.runtime import held
from telemill.llm.words import WHITE, Memo, remembered, sums, words

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[33:48] = _PUNCT[58:65] = _PUNCT[91:97] = _PUNCT[123:127] = True
_SURE = np.ones(256, bool)  # first bytes that surely start no white space
_SURE[[*range(0, 33), 0x7F, 0x85, 0xC2, 0xE1, 0xE2, 0xE3]] = False
_PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
_LED = re.compile(" [A-Za-zÀ-ÖØ-öø-ÿ]+")


def _after_letter(data: np.ndarray) -> np.ndarray:
    """Whether the byte before each byte ends an ASCII or Latin-1 letter."""
    end = _LETTER[data]
    tail = np.zeros(len(data), bool)
    tail[1:] = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7) & (data[1:] >= 0x80)
    out = np.zeros(len(data), bool)
    out[1:] = (end | tail)[:-1]
    return out


class Encoder:
    """``encode`` gives the ids of a block of texts as the library's ``encode(text, add_special_tokens=False)`` does."""

    def __init__(self, path: str, limit: int = 1_500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.by_word = bool(spec["model"].get("end_of_word_suffix"))
        self.specials = [t["content"].encode() for t in spec["added_tokens"]]
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.size = size
        self.kind = np.uint16 if size <= 1 << 16 else np.uint32
        # byte-level vocabularies write the unprintable bytes as the characters from 256 on, in order
        hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
        self.letters = {b: 256 + k for k, b in enumerate(hidden)}
        self.memo = Memo(self.kind, limit)

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Parts whose ids are those of the whole, one after the other.

        By word: white space is dropped and parts no word crosses; also between a letter and ASCII punctuation.
        Else: before a space that a visible character follows, after a letter that no letter follows, and after one
        line feed that stands between other characters than white space.
        """
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        after = _after_letter(data)
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        edge = edge[:-1]
        mark = after & _PUNCT[data] & ~edge
        if self.by_word:
            starts, ends = words(data, offsets)
            more = np.flatnonzero(mark)
            return np.sort(np.concatenate([starts, more])), np.sort(np.concatenate([ends, more]))
        visible = np.zeros(len(data), bool)
        visible[:-1] = _SURE[data[1:]] & ~edge[1:]
        mark |= (data == 32) & visible
        mark |= after & (data == 10)
        lone = np.zeros(len(data), bool)  # after a line feed that follows a letter or punctuation
        lone[2:] = (data[1:-1] == 10) & (_PUNCT | _LETTER)[data[:-2]] & _LETTER[data[2:]]
        lone[1:] &= ~edge[:-1]
        starts = np.flatnonzero(mark | lone | edge)
        return starts, np.append(starts[1:], len(data))

    def _new(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new parts: words of plain letters go straight to the library's merges, all others through all of it."""
        texts = [p.decode("utf-8", "replace") for p in parts]
        match, merge = (_PLAIN if self.by_word else _LED).fullmatch, self.tokenizer.model.tokenize
        found: list[list[int] | None] = [None] * len(texts)
        rest = []
        for i, text in enumerate(texts):
            if not match(text):
                rest.append(i)
                continue
            if self.by_word:
                text = text.lower()
            if not text.isascii() or not self.by_word:
                text = text.encode().decode("latin-1").translate(self.letters)
            found[i] = [t.id for t in merge(text)]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)):
            found[i] = e.ids
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(itertools.chain.from_iterable(found), self.kind, int(sizes.sum())), sizes

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the bounds of each text in them."""
        whole = self._special(data, offsets)
        starts, ends = self.cuts(data, offsets)
        if len(whole):
            inside = np.isin(np.searchsorted(offsets, starts, "right") - 1, whole)
            starts, ends = starts[~inside], ends[~inside]
        flat, sizes = remembered(self.memo, data, starts, ends, self._new)
        counts = sums(sizes, np.searchsorted(starts, offsets, "left"))
        bounds = np.concatenate([[0], np.cumsum(counts)])
        if len(whole):
            lists = [flat[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            for i in whole.tolist():
                lists[i] = np.array(self._ids(data[offsets[i]:offsets[i + 1]].tobytes().decode("utf-8", "replace")),
                                    self.kind)
            flat = np.concatenate(lists)
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
        return flat, bounds

    def _special(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        text, found = data.tobytes(), set()
        for special in self.specials:
            at = text.find(special)
            while at >= 0:
                found.add(int(np.searchsorted(offsets, at, "right")) - 1)
                at = text.find(special, at + 1)
        return np.array(sorted(found), np.int64)


def encoder(path: str) -> Encoder:
    """One per worker process, kept for its later tasks."""
    return held(("encoder", path), lambda: Encoder(path))
