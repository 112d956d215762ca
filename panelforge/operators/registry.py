"""Named feature blocks with declared keys, built and joined by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..sources.files import assemble, cached
from .ordered import listed


class Registry:
    """Feature functions ``fn(df) -> block``; every block carries the keys."""

    def __init__(self, keys):
        self.keys = listed(keys)
        self.blocks: dict[str, Callable[[DataFrame], DataFrame]] = {}

    def block(self, fn: Callable[[DataFrame], DataFrame]):
        """Register a function under its name."""
        if fn.__name__ in self.blocks:
            raise ValueError(f"{fn.__name__} is registered twice")
        self.blocks[fn.__name__] = fn
        return fn

    def __getitem__(self, name):
        return self.blocks[name]

    def build(self, df, names=None, store: str | None = None) -> DataFrame:
        """The named blocks (all, if not given) side by side; ``store`` keeps each block under that prefix."""
        made = {}
        for name in sorted(names or self.blocks):
            fn = self.blocks[name]
            made[name] = fn(df) if store is None else cached(df.sparkSession, f"{store}_{name}", lambda fn=fn: fn(df))
        return assemble(made, self.keys)
