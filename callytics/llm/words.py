"""Words of texts as 64-bit hashes, and hashes of windows of words, a batch at a time."""

from __future__ import annotations

import re

import numpy as np

from callytics.llm.common import worker_memory

#: A word is a longest run of letters and digits, in lower case. The same set as Java's [\\p{L}\\p{N}]+.
WORD = re.compile(r"[^\W_]+")
HAS_WORD = r"[\p{L}\p{N}]"
REMEMBERED = 400_000


class Hashes(dict):
    """Word -> 64-bit hash; a worker remembers a bounded number of them."""

    def __missing__(self, word: str) -> int:
        import xxhash

        value = xxhash.xxh64_intdigest(word)
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value
        return value


def hashes() -> Hashes:
    return worker_memory("words", Hashes)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that scatters them (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and the number of words of each text."""
    known = hashes().__getitem__
    parts = [np.fromiter(map(known, WORD.findall(t.lower())), np.uint64) if t else np.empty(0, np.uint64) for t in texts]
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), np.array([len(p) for p in parts], np.int64)


def window_hashes(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the windows of `width` words: (text number, place of the first word, hash).

    A text with fewer words has one window of all its words; a text without words has none.
    """
    if not len(words):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    text = np.repeat(np.arange(len(counts)), counts)
    begin = np.concatenate([[0], np.cumsum(counts)[:-1]])
    place = np.arange(len(words)) - begin[text]
    left = counts[text] - place  # words from here to the end of the text
    total = np.zeros(len(words), np.uint64)
    for j in range(width):
        factor = np.uint64((0x9E3779B97F4A7C15 * (2 * j + 1)) & (2**64 - 1))
        total += np.where(left > j, mix(padded[j : j + len(words)] + np.uint64(j + 1)) * factor, np.uint64(0))
    whole = (left >= width) | (place == 0)
    return text[whole], place[whole], mix(total[whole])
