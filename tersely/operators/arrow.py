"""The sequential operators as Arrow UDFs: a document a value, without a shuffle; and the whole pipeline in one of them."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tersely.operators import kernels


def on_text(step: Callable[[str], str]):
    """A function of texts as a column function; null stays null."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else step(t) for t in texts], dtype=object)

    return run


def on_lines(step: Callable[[list[str]], list[str]]):
    return on_text(lambda t: "\n".join(step(kernels.lines(t))))


def template_dedup(text: Column) -> Column:
    return on_lines(kernels.template_dedup)(text)


def collapse_frames(text: Column) -> Column:
    return on_lines(kernels.collapse_frames)(text)


def block_dedup(text: Column) -> Column:
    return on_lines(kernels.block_dedup)(text)


def factor_prefix(text: Column) -> Column:
    return on_lines(kernels.factor_prefix)(text)


def factor_suffix(text: Column) -> Column:
    return on_lines(kernels.factor_suffix)(text)


def shorten_paths(text: Column) -> Column:
    return on_text(kernels.shorten_paths)(text)


def strip_prose(text: Column) -> Column:
    return on_text(kernels.strip_prose)(text)


LAYER1 = "output string, pre_filtered boolean, lines_removed int, applied_rules array<string>"
LAYER2 = "output string, applied_rules array<string>"


def layer1(text: Column, keep_controls: bool = False) -> Column:
    @F.pandas_udf(LAYER1)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None, None, None) if t is None else kernels.layer1(t, keep_controls) for t in texts], columns=["output", "pre_filtered", "lines_removed", "applied_rules"])

    return run(text)


def layer2(text: Column) -> Column:
    @F.pandas_udf(LAYER2)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None) if t is None else kernels.layer2(t) for t in texts], columns=["output", "applied_rules"])

    return run(text)

