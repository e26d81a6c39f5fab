"""Columns that a table brings along beside those of documents."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame

OWN = ("doc_id", "text", "lang", "source", "n_chars")


def keeps_other_columns(run: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """`run(docs, ...)`, which returns rows of `docs` with its columns, for tables with any other columns.

    They go through it as other_0, other_1, ..., whatever their names, so none of them meets a column that `run` makes.
    """

    @functools.wraps(run)
    def renamed(docs: DataFrame, *args, **settings) -> DataFrame:
        other = {c: f"other_{i}" for i, c in enumerate(c for c in docs.columns if c not in OWN)}
        if not other:
            return run(docs, *args, **settings)
        out = run(docs.toDF(*(other.get(c, c) for c in docs.columns)), *args, **settings)
        back = {v: k for k, v in other.items()}
        return out.toDF(*(back.get(c, c) for c in out.columns))

    return renamed
