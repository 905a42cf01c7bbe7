"""Words of texts as numbers and hashes, for tasks in Python workers."""

from __future__ import annotations

from itertools import islice

import numpy as np
import xxhash

#: Distinct words that a task remembers; beyond it the memory starts anew.
REMEMBERED = 50_000


class Words:
    """Numbers the distinct words of a task's texts and hashes each once."""

    def __init__(self):
        self.ids: dict[bytes, int] = {}
        self.hashes = np.zeros(1 << 12, np.uint64)

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and hashes of the text's words in order."""
        ids, words = self.ids, text.encode("utf-8", "surrogatepass").split()
        if len(ids) > REMEMBERED:
            ids.clear()
        known = len(ids)
        found = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
        if len(ids) > len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros(len(ids), np.uint64)])
        for w in islice(reversed(ids), len(ids) - known):
            self.hashes[ids[w]] = xxhash.xxh64_intdigest(w)
        return found, self.hashes[found]
