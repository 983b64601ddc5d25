"""Cleaning-session semantics.

g1 reset: return to the frame as first loaded. g2 commit: publish the cleaned frame — written as
Parquet to the shared checkpoint folder and re-read, which cuts the lineage of the chain of
operators (and survives executor loss). g3: a fitted model checks its features at scoring.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from quarry.session import materialize


class Workspace:
    def __init__(self, df: DataFrame):
        self.original = df
        self.current = df
        self.history: list[str] = []

    def apply(self, op: Callable[..., DataFrame | tuple], *args, **kwargs) -> DataFrame:
        """Run an operator on the current frame (tuple results keep their DataFrame part)."""
        out = op(self.current, *args, **kwargs)
        self.current = out[0] if isinstance(out, tuple) else out
        self.history.append(getattr(op, "__name__", str(op)))
        return self.current

    def reset(self) -> DataFrame:
        """g1: back to the frame as first loaded in this session."""
        self.current = self.original
        self.history.clear()
        return self.current

    def commit(self, name: str = "committed") -> DataFrame:
        """g2: materialise the cleaned frame (Parquet in the shared checkpoint folder) and make it
        the new starting point."""
        self.current = materialize(self.current, name)
        self.original = self.current
        self.history.clear()
        return self.current
