"""Token ids of many words at once: each distinct word is encoded once a worker."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np


class WordIds(dict):
    """word -> its ids, as bytes of 32-bit integers; encode is called for words
    not held. At limit words the table becomes the older one and a new one begins,
    into which words come back when they are met again: words of the last limit
    that were met last stay, memory is bounded, and ids don't change."""

    def __init__(self, encode: Callable[[str], Iterable[int]] | None = None, limit: int = 300_000):
        super().__init__()
        self.encode, self.limit = encode, limit
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.pop(word, None)
        if ids is None:
            ids = self.made(word)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def made(self, word: str) -> bytes:
        return np.array(self.encode(word), np.int32).tobytes()

    def texts(self, words: list[list[str]], end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts, given as lists of words, in one array, each text's
        with end behind it, and the place where each text's ids end."""
        get, join = self.__getitem__, b"".join
        each = [join(map(get, x)) + end for x in words] if end else [join(map(get, x)) for x in words]
        return np.frombuffer(join(each), np.int32), np.cumsum([len(x) // 4 for x in each], dtype=np.int64)
