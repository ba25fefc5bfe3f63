"""Token counts with a compiled finite-state tokenizer (see transducer.py)."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lumenframe.llm.transducer import compiled


def vocabulary(path: str) -> bytes:
    """A vocabulary file, read by the driver; a few MB, sent to the tasks as a broadcast variable."""
    return Path(path).read_bytes()


def counter(docs: DataFrame, path: str):
    """A column function: text -> number of tokens under the vocabulary file at ``path``."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    @F.pandas_udf("long")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = compiled(shared.value)
        for texts in parts:
            yield pd.Series(machine.counts(texts.tolist()), dtype="int64")

    return count


def token_counts(docs: DataFrame, path: str, limit: int = 1024, id: str = "doc_id", text: str | Column = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row; equal rows give equal rows.

    A null text counts as empty: 0 bytes, 0 tokens. A null id stays null. Texts are read whole,
    however long. Other columns of ``docs`` are left out, so their names cannot clash. No shuffle.
    """
    body = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return (docs.select(F.col(id).alias(id), body.alias("body"))
            .select(id, F.octet_length("body").cast("long").alias("n_bytes"), counter(docs, path)("body").alias("n_tokens"))
            .withColumn("over_limit", F.col("n_tokens") > limit))
