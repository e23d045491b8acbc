"""The boundary to services that answer about texts: embeddings and summaries, in small batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH = 10
LEAST_CODE, MOST_CODE = 10, 150_000


def answered(rows: DataFrame, text_col: str, connect: Callable[[], Callable[[list[str]], list]], kind: str, name: str, batch: int = BATCH) -> DataFrame:
    """``rows`` with the service's answer in column ``name`` of type ``kind``.

    ``connect`` runs once per task and returns the function that answers a batch of texts.
    A batch that fails gives nulls, as do null texts; the other rows keep their answers.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = connect()
        for frame in frames:
            out: list = [None] * len(frame)
            texts = [(i, t) for i, t in enumerate(frame[text_col]) if isinstance(t, str)]
            for lo in range(0, len(texts), batch):
                part = texts[lo : lo + batch]
                try:
                    answers = ask([t for _, t in part])
                except Exception:  # noqa: BLE001  a service's failure is data here: its rows get nulls
                    continue
                for (i, _), a in zip(part, answers, strict=True):
                    out[i] = a
            yield frame.assign(**{name: pd.Series(out, index=frame.index, dtype=object)})

    return rows.mapInPandas(run, f"{fields}, `{name}` {kind}")


def summaries(code: DataFrame, connect: Callable, code_col: str = "code") -> DataFrame:
    """Summaries of code with something in it; code that is too long is cut and says so."""
    from graphweir.functions.text import truncated

    worth = code.filter(F.length(F.trim(code_col)) >= LEAST_CODE).withColumn("__text", truncated(F.col(code_col), MOST_CODE))
    return answered(worth, "__text", connect, "string", "summary").drop("__text")
