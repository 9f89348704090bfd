"""Hooks for scripts, expressions given as text, and named text processors."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarisk.operators import language


class Script:
    """A script as a plan: ``setup`` prepares the rows, ``process_line`` adds to each, ``run_main_step`` works on all, ``wrap_up`` finishes.

    Each hook takes and gives a DataFrame, so that a script is planned as a whole; those that are not overridden change nothing.
    """

    def setup(self, df: DataFrame) -> DataFrame:
        return df

    def process_line(self, df: DataFrame) -> DataFrame:
        return df

    def run_main_step(self, df: DataFrame) -> DataFrame:
        return df

    def wrap_up(self, df: DataFrame) -> DataFrame:
        return df

    def run(self, df: DataFrame) -> DataFrame:
        return df.transform(self.setup).transform(self.process_line).transform(self.run_main_step).transform(self.wrap_up)


def evaluated(expressions: Mapping[str, str]) -> list[Column]:
    """Columns of SQL expressions by name. They are parsed as expressions of rows; no code is run."""
    return [F.expr(e).alias(name) for name, e in expressions.items()]


TextProcessor = Callable[[DataFrame, str], DataFrame]


def _lower_words(docs: DataFrame, key: str) -> DataFrame:
    return language.word_tokens(docs, key, punctuation=False).withColumn("token", F.lower("token"))


_PROCESSORS: dict[str, TextProcessor] = {"tokens": language.word_tokens, "sentences": language.sentences, "lower_words": _lower_words}


def register_processor(name: str, processor: TextProcessor) -> None:
    """Names a function from documents (key, text) to rows; a name in use is refused."""
    if name in _PROCESSORS:
        raise ValueError(f"text processor {name} is registered already")
    _PROCESSORS[name] = processor


def text_processor(name: str) -> TextProcessor:
    """The text processor of a name; unknown ones raise ``ValueError`` with those that exist."""
    if name not in _PROCESSORS:
        raise ValueError(f"no text processor {name}; there are {', '.join(sorted(_PROCESSORS))}")
    return _PROCESSORS[name]
