"""A one-sided filter of fixed size for keys that are too many to broadcast.

A bitmap of ``bits`` bits marks the hashed keys. Its size is a parameter and does not
grow with the data, so it may go to every task. A key that is not marked is surely
absent; a marked one still has to be joined. With more keys than bits the filter lets
all rows pass: slower, never wrong.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from textprov.llm.arrow import lean
from textprov.llm.flat import U, mix64

BITS = 1 << 25  # 4 MB


def place(keys: np.ndarray, bits: int) -> np.ndarray:
    """Bit of each key, for int64 or uint64 keys."""
    return (mix64(keys.view(U)) & U(bits - 1)).astype(np.int64)


def key_bitmap(keys: DataFrame, column: str, bits: int = BITS) -> Broadcast:
    """Mark every key of a long column; at most ``bits / 64`` numbers reach the driver.

    Tasks turn their keys into marked bits, equal words are merged by a partial
    aggregation, and only the merged words travel.
    """
    def words(batches):
        for b in batches:
            k = b.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.unique(place(k, bits))
            word, bit = at >> 6, (at & 63).astype(U)
            yield pa.RecordBatch.from_arrays(
                [pa.array(word), pa.array((U(1) << bit).view(np.int64))], names=["word", "bit"]
            )

    found = (
        keys.select(F.col(column).cast("long"))
        .mapInArrow(words, "word long, bit long")
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bit"))
        .toArrow()
    )
    map_ = np.zeros(bits // 64, np.int64)
    map_[found.column("word").to_numpy()] = found.column("bit").to_numpy()
    return keys.sparkSession.sparkContext.broadcast(map_.view(np.uint8))


def marked(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = place(keys, len(bitmap) * 8)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def split(df: DataFrame, column: str, bitmap: Broadcast) -> tuple[DataFrame, DataFrame]:
    """Rows whose long ``column`` is surely not marked, and the rest; all columns stay."""

    def side(want: bool) -> DataFrame:
        def run(batches):
            for b in batches:
                k = b.column(at).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                hit = marked(bitmap.value, k) & ~b.column(at).is_null().to_numpy(zero_copy_only=False)
                yield b.filter(pa.array(hit == want))

        return lean(df).mapInArrow(run, df.schema)

    at = df.columns.index(column)
    return side(False), side(True)


def without(df: DataFrame, keys: DataFrame, column: str, *also: str) -> DataFrame:
    """Rows whose ``column``, with ``also`` if given, is not in ``keys``; nulls stay.

    Only rows that the bitmap marks are moved to meet the keys.
    """
    clear, maybe = split(df, column, key_bitmap(keys, column))
    by = [column, *also]
    return clear.unionByName(maybe.join(keys.select(*by).distinct(), by, "left_anti"))
