"""A bounded cache for work on repeated words."""

from __future__ import annotations

from collections.abc import Callable


class WordCache:
    """Maps words to values; holds the words seen of late, twice ``size`` at most."""

    def __init__(self, compute: Callable[[list[str]], list], size: int = 250_000):
        self.compute, self.size, self.young, self.old = compute, size, {}, {}

    def get(self, words: list[str]) -> list:
        young = self.young
        out = [young.get(w) for w in words]
        if None not in out:
            return out
        lost = {w for w, v in zip(words, out, strict=True) if v is None}
        fresh = {}
        old = self.old
        missing = []
        for w in lost:
            v = old.get(w)
            if v is None:
                missing.append(w)
            else:
                fresh[w] = v
        if missing:
            fresh.update(zip(missing, self.compute(missing), strict=True))
        out = [fresh[w] if v is None else v for w, v in zip(words, out, strict=True)]
        young.update(fresh)
        if len(young) > self.size:
            self.old, self.young = young, {}
        return out
