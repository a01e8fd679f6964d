"""What a run names in its options: text baselines and answering models, by name; unknown names are refused."""

from __future__ import annotations

from collections.abc import Callable
from typing import Generic, TypeVar

import pandas as pd

T = TypeVar("T")


class Names(Generic[T]):
    """Entries by name. A name stands for one entry; asking for another one is an error that says which there are."""

    def __init__(self, what: str):
        self.what, self.entries = what, {}

    def register(self, name: str) -> Callable[[T], T]:
        def keep(entry: T) -> T:
            if name in self.entries:
                raise ValueError(f"{self.what} {name!r} is there already")
            self.entries[name] = entry
            return entry

        return keep

    def __getitem__(self, name: str) -> T:
        if name not in self.entries:
            raise ValueError(f"unknown {self.what} {name!r}; there are {', '.join(sorted(self.entries)) or 'none'}")
        return self.entries[name]

    def __iter__(self):
        return iter(sorted(self.entries))


#: (pools, queries, docs, key) to scored pools, as ``bm25_scores``.
TEXT_BASELINES: Names[Callable] = Names("text baseline")
#: A loader, called once in a worker, of what answers (video, rows with a prompt) with one text a row.
MODELS: Names[Callable[[], Callable[[str, pd.DataFrame], list[str]]]] = Names("answering model")


@TEXT_BASELINES.register("bm25")
def _bm25(*args, **kwargs):
    from spindrift.operators.bm25 import bm25_scores

    return bm25_scores(*args, **kwargs)


@MODELS.register("stand-in")
def stand_in() -> Callable[[str, pd.DataFrame], list[str]]:
    """Deterministic, for want of weights: the answer is the prompt's length."""
    return lambda video, rows: [f"Answer: {len(p) % 5}" for p in rows["prompt"]]
