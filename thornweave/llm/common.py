"""What the text operators share: tables and words."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import fresh_path, gathered, in_arrow, materialise, remove, shared_folder, small  # noqa: F401

#: A word is a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE, -1), lambda w: w != "")


def in_slices(batches: Iterator, rows: int = 256) -> Iterator:
    """Batches cut small: what is made from one, where that is as large as the texts, leaves before the next is begun."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


_BREAK = re.compile(rb"[\x20\x09-\x0D]")


def word_blocks(data: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text in order, in lists from about `size` bytes each, so that a very long text is never held as words whole."""
    at = 0
    while at < len(data):
        cut = _BREAK.search(data, at + size) if len(data) - at > size else None
        end = cut.start() if cut else len(data)
        yield data[at:end].split()
        at = end
