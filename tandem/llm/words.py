"""Word sequences as numpy arrays, for operators that work inside Python tasks."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
from collections.abc import Callable

import numpy as np
import xxhash

#: A-Z to a-z, everything else unchanged. UTF-8 bytes of other characters are never touched.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: As LOWER, and every ASCII character that is neither letter nor digit becomes a space.
PLAIN = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in LOWER)
#: Odd multiplier of the rolling hash over word ids.
BASE = 0x9E3779B97F4A7C15


def of_process(name: str, make: Callable[[], object]) -> object:
    """An object that a worker process makes once and keeps from task to task; only for what depends on ``name`` alone and does not grow."""
    kept = sys.modules.setdefault("_kept_by_worker", types.ModuleType("_kept_by_worker")).__dict__
    if name not in kept:
        kept[name] = make()
    return kept[name]


def give_back() -> None:
    """Hand freed memory back to the system at a task's end, so that an idle worker holds no more than its models."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


class Memo(dict):
    """What a task remembers, up to about ``limit`` bytes; beyond that it is emptied, which changes no result.

    Sizes are those of keys and values with what Python needs to hold them, so a few very long keys count for what they are.
    """

    OVERHEAD = 240

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.held = limit, 0

    def learn(self, keys: list, values: list) -> None:
        """Add the pairs of two lists of texts or bytes."""
        self.held += sum(map(len, keys)) + sum(map(len, values)) + self.OVERHEAD * len(keys)
        self.update(zip(keys, values))

    def full(self) -> bool:
        return self.held > self.limit

    def clear(self) -> None:
        super().clear()
        self.held = 0


class WordIds(dict):
    """64-bit id of a word, remembered; the memory is emptied at ``limit`` words, which changes no id."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def plain_words(text: str | None) -> list[bytes]:
    """Lower-cased words without ASCII punctuation; none for a null text."""
    return (text or "").encode("utf-8", "surrogatepass").translate(PLAIN).split()


def grams(ids: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` ids; empty when there are fewer."""
    count = len(ids) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for i in range(n):
        out = out * np.uint64(BASE) + ids[i:i + count]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))
