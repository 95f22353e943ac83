"""Exact token ids of a word-ending BPE tokenizer file, cached by word inside Arrow tasks."""

from __future__ import annotations

import os
import sys
from array import array

import numpy as np

#: Bytes of words and ids that a worker remembers before it forgets the older half.
REMEMBERED = 96 << 20
#: What an entry takes besides its bytes.
ENTRY = 170


def as_ids(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit bytes; an array is made faster than numpy's for a few."""
    if sys.byteorder == "little" and array("I").itemsize == 4:
        return array("I", ids).tobytes()
    return np.asarray(ids, "<u4").tobytes()


class WordIds:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, equal to ``tokenizer.encode``.

    The tokenizer drops white space and none of its pieces crosses it, so a text's ids are its
    words' ids one after another. Words of Latin letters, with marks of punctuation behind or not,
    go straight to the tokenizer's BPE model; every other word goes through ``encode``. A word's
    other forms (capitals, marks behind) are remembered from the second time on that any of them
    occurs, so that words which occur once take one entry.
    """

    #: ASCII punctuation that is one piece of the pre-tokenizer's behind letters, alone or together; an apostrophe may begin an ending.
    MARKS = b'!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.held = 0
        before = self.tokenizer.pre_tokenizer
        plain = [chr(c) for c in range(0x41, 0x180) if chr(c).isalpha() and c != 0x130]
        self.bytes_of = {c.lower(): "".join(x for x, _ in before.pre_tokenize_str(c.lower())) for c in plain if len(c.lower()) == 1 and ord(c.lower()) < 0x180}
        self.letters = set(plain) & {c for c in plain if c.lower() in self.bytes_of}
        self.marks: dict[bytes, bytes] = {}

    def _encode(self, text: str) -> bytes:
        return as_ids(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _keep(self, word: bytes, ids: bytes) -> bytes:
        self.held += len(word) + len(ids) + ENTRY
        if self.held > REMEMBERED // 2:
            self.old, self.young, self.held = self.young, {}, 0
        self.young[word] = ids
        return ids

    def _behind(self, marks: bytes) -> bytes:
        if (ids := self.marks.get(marks)) is None:
            ids = self._encode(marks.decode())
            if len(self.marks) < 10_000 and len(marks) < 100:
                self.marks[marks] = ids
        return ids

    def _lowered(self, body: bytes) -> bytes | None:
        """The lower-cased body, if it has nothing but known letters."""
        if body.isalpha():  # ASCII
            return body.lower()
        text = body.decode()
        return text.lower().encode() if text and self.letters.issuperset(text) else None

    def _word(self, word: bytes) -> bytes:
        if (ids := self.old.get(word)) is not None:
            return self._keep(word, ids)
        body = word.rstrip(self.MARKS)
        key = self._lowered(body)
        if key is None:
            return self._keep(word, self._encode(word.decode()))
        if (ids := self.young.get(key)) is None:
            known = (ids := self.old.get(key)) is not None
            if not known:
                made = key.decode()
                made = made if made.isascii() else "".join(map(self.bytes_of.__getitem__, made))
                ids = as_ids([t.id for t in self.tokenizer.model.tokenize(made)])
            self._keep(key, ids)
            if not known:
                return ids + self._behind(word[len(body) :]) if len(body) < len(word) else ids
        if len(body) < len(word):
            ids += self._behind(word[len(body) :])
        return self._keep(word, ids) if word != key else ids

    def __call__(self, text: bytes) -> bytes:
        get, words = self.young.get, text.split()
        found = list(map(get, words))
        if None in found:
            for i, x in enumerate(found):
                if x is None:
                    w = words[i]
                    found[i] = self.young.get(w) or self._word(w)
        return b"".join(found)


_loaded: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The tokenizer of this worker process, read once."""
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]
