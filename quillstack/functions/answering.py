"""Answers from a question and its context, behind an interface: a factory that makes an answerer once in each task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: From questions and their contexts to answers, a batch at a time.
Answerer = Callable[[list[str], list[str]], list[str]]


def extract(text: Column, sentences: int = 2) -> Column:
    """The first sentences of a text: a stand-in for a generated answer."""
    return F.array_join(F.slice(F.split(text, r"(?<=[.!?])\s+"), 1, sentences), " ")


def answer(question: Column, context: Column, factory: Callable[[], Answerer]) -> Column:
    """Answers of the factory's answerer; null questions and contexts count as empty."""

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        say = factory()
        for questions, contexts in batches:
            yield pd.Series(say(questions.fillna("").tolist(), contexts.fillna("").tolist()), dtype=object)

    return run(question, context)
