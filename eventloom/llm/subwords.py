"""Ids of a public vocabulary, by the tokenizers library, with a bounded cache of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

VOCABULARY = "word_bpe_49k.json"
#: Words that a task remembers with their ids; bounds its memory, not the result.
REMEMBERED = 1_000_000
_encoders: dict[str, WordIds] = {}


class _Numbers(dict):
    """Numbers of words in order of appearance; a new word is noted."""

    new: list[str]

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = number = len(self)
        return number


class WordIds:
    """``add_special_tokens=False`` ids of whole texts, as little-endian unsigned 32-bit bytes.

    The vocabulary drops white space and never merges across it, so the ids of a text are
    those of its words one after another. A word's ids are remembered; new words are
    encoded many at a time and cut apart by the bytes that each id stands for.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.ends, self.lengths = np.zeros(self.size, bool), np.zeros(self.size, np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i], self.lengths[i] = token.endswith("</w>"), len(token.removesuffix("</w>"))
        self._forget()

    def _forget(self) -> None:
        self.numbers, self.new = _Numbers(), []
        self.numbers.new = self.new
        self.flat, self.starts = np.zeros(0, "<u4"), np.zeros(1, np.int64)

    @classmethod
    def shared(cls, path: str) -> WordIds:
        """One for all tasks of a Python worker."""
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def encode(self, words: list[str], group: int = 250) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some words one after another, and how many each has; nothing is remembered."""
        flat, sizes = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for i in range(0, len(words), group):
            part = words[i : i + group]
            text = " ".join(part)
            size = np.fromiter((len(w.encode()) for w in part), np.int64, len(part))  # an id's token has a character per byte
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            upto, until = np.cumsum(size), np.cumsum(self.lengths[ids])
            at = np.searchsorted(until, upto)
            if not len(ids) or at[-1] != len(ids) - 1 or (until[at] != upto).any():  # some id's bytes are not the word's own
                found = [x.ids for x in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
                ids = np.array([x for one in found for x in one], "<u4")
                sizes.append(np.fromiter(map(len, found), np.int64, len(part)))
            else:
                sizes.append(np.diff(at, prepend=-1))
            flat.append(ids)
        return np.concatenate(flat), np.concatenate(sizes)

    def _learn(self) -> None:
        """Gives every new word its ids."""
        if self.new:
            flat, sizes = self.encode(self.new)
            self.flat = np.concatenate([self.flat, flat])
            self.starts = np.append(self.starts, self.starts[-1] + np.cumsum(sizes))
        self.new.clear()

    def words(self, text: str | None) -> list[str]:
        """The words ``[^\\x20\\x09-\\x0D]+`` of a text, in lower case where that cannot change an id."""
        text = text or ""
        if "<|" not in text and "Σ" not in text:
            text = text.lower()
        for c in "\n\t\r\x0b\x0c":
            if c in text:
                text = text.replace(c, " ")
        return [w for w in text.split(" ") if w]

    def texts(self, texts: list[str | None], most: int = 1 << 20) -> Iterator[np.ndarray]:
        """The ids of each text, little-endian unsigned 32 bits."""
        i = 0
        while i < len(texts):
            rows, held = [], 0
            while i < len(texts) and (not rows or held < most):
                rows.append(list(map(self.numbers.__getitem__, self.words(texts[i]))))
                held += len(texts[i] or "")
                i += 1
            self._learn()
            for row in rows:
                number = np.array(row, np.int64)
                start = self.starts[number]
                size = self.starts[number + 1] - start
                upto = np.cumsum(size)
                yield self.flat[np.arange(upto[-1] if len(upto) else 0) + np.repeat(start - upto + size, size)]
            if len(self.numbers) > REMEMBERED:
                self._forget()
