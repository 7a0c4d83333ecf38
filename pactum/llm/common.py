"""What the operators of this subpackage share: table access, shared storage, folds."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import remove, shared_dir, shared_path, stored

__all__ = ["LOWER", "SPACES", "UPPER", "ascii_lower", "fold", "give_back", "let_go", "remove", "shared_dir", "shared_path", "stored", "table"]

#: ``[\x20\x09-\x0D]``: the white space that the word rules split on.
SPACES = " \t\n\x0b\x0c\r"
#: What empties the tables that a Python worker keeps from task to task.
KEEPERS: list[Callable[[], None]] = []
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def give_back() -> None:
    """Memory that a Python worker has freed, but holds, goes back to the system: it serves one
    task after the other."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def let_go() -> None:
    """For the start of a task: a Python worker serves all operators, one after the other. What
    the one before kept goes, and the memory that it freed goes back to the system."""
    for empty in KEEPERS:
        empty()
    give_back()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def fold(doc_id: Column, modulus: int = 5) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus
