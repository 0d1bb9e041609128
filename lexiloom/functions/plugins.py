"""Outside scorers and candidate providers, run on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def score_with(rows: DataFrame, scorer: Callable[[pd.DataFrame], pd.Series], column: str = "score") -> DataFrame:
    """``rows`` with a score of each row and its outcome: Scored, or Failed with a null score where the scorer raises on the batch."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            try:
                yield frame.assign(**{column: scorer(frame).astype(float), "outcome": "Scored"})
            except Exception:  # an observer never stops the job; its failure is a result
                yield frame.assign(**{column: None, "outcome": "Failed"})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(run, f"{fields}, `{column}` double, outcome string")


def provide(tokens: DataFrame, provider: Callable[[str], list[tuple]], schema: str) -> DataFrame:
    """token and the provider's rows for each of ``tokens(token)``; schema names and types the provider's columns."""
    names = [part.split()[0] for part in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([(t, *row) for t in frame["token"] for row in provider(t)], columns=["token", *names])

    return tokens.select("token").mapInPandas(run, f"token string, {schema}")
