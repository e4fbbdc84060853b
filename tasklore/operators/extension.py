"""Seams for user code: answers produced by any callable, and vectorised custom predicates."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TypeVar

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

T = TypeVar("T")


def attempt(call: Callable[[], T]) -> T | None:
    """The result of user code, or None if it raises."""
    try:
        return call()
    except Exception:
        return None


def with_answers(prompts: DataFrame, provider: Callable[[list[str]], list[str]], prompt: str = "prompt",
                 answer: str = "answer", batch: int = 64) -> DataFrame:
    """Ask a provider for one answer per prompt, in batches of bounded size.

    A batch that raises, or answers another number of prompts, is asked again prompt by prompt; only those that fail alone get null.
    """
    columns = prompts.columns

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start:start + batch]
                asked = part[prompt].tolist()
                replies = attempt(lambda asked=asked: list(provider(asked)))
                if replies is None or len(replies) != len(asked):
                    single = [attempt(lambda one=one: list(provider([one]))) for one in asked]
                    replies = [found[0] if found and len(found) == 1 else None for found in single]
                yield part.assign(**{answer: replies})[[*columns, answer]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema) + f", `{answer}` string"
    return prompts.mapInPandas(ask, schema)


def vectorised_predicate(test: Callable[[pd.Series], pd.Series]) -> Callable[[dict[str, Column]], Column]:
    """A pandas test over messages as a named-rule predicate; a message on which it raises is no match, others are not affected."""
    @F.pandas_udf("boolean")
    def run(messages: pd.Series) -> pd.Series:
        whole = attempt(lambda: test(messages).astype(bool))
        if whole is not None:
            return whole
        return pd.Series([attempt(lambda at=at: bool(test(messages.iloc[at:at + 1]).iloc[0])) for at in range(len(messages))], dtype="object")

    return lambda line: run(line["message"])
