"""What the operators share: table scans, word rules, keys for deterministic draws."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditfeat.staging import ship_package, stage

__all__ = ["SPACE", "WORD", "fold_of", "lower_ascii", "pick", "ship_package", "stage", "table", "worker_state"]

# White space of the contracts: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, cast: ``pick(df, doc_id="bigint", text="string")``. Extra columns
    of any name are left behind, so they can't clash with what an operator adds."""
    return df.select(*[F.col(f"`{name}`").cast(kind).alias(name) for name, kind in columns.items()])


def fold_of(key: Column, folds: int = 5) -> Column:
    """crc32 of the key as text, modulo ``folds``; a null key falls in the fold of the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds


_ASCII_LOWER = {ord(c): c.lower() for c in _UPPER}


def lower_ascii(text: str) -> str:
    """Lower-case A-Z only; other letters stay."""
    return text.lower() if text.isascii() else text.translate(_ASCII_LOWER)


_held: dict[Hashable, Any] = {}


def worker_state(key: Hashable, make: Callable[[Any], Any]) -> Any:
    """What a Python worker keeps from task to task under ``key``, made by ``make(key)``. A worker
    serves one operator after the other, so only the latest one's state is kept: asking for another
    frees it and gives the memory back before the next one grows."""
    if key not in _held:
        _held.clear()
        gc.collect()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # not every C library has it
            pass
        _held[key] = make(key)
    return _held[key]
