"""Bitmaps of hashed values, of a bounded size: they tell workers which rows can't matter."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import shuffles_cleaned

PIECE = 1 << 16


def place(bits: int, *columns: str):
    """A row's place in a map of so many bits."""
    return F.pmod(F.xxhash64(*columns), F.lit(bits))


def bits_for(rows: int) -> int:
    """Bits of a map of so many rows: eight a row, at most 2^27, which is 16 MB; a fuller map only lets more rows pass."""
    return 1 << min(27, max(16, (8 * rows).bit_length()))


def within(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    return (bitmap[h >> 3] >> (7 - (h & 7)).astype(np.uint8)) & 1 == 1


def bitmap(rows: DataFrame, bits: int, *columns: str) -> np.ndarray:
    """A map of the places of the columns' values, made in pieces of 8 kB."""

    def run(batches):
        seen = {}
        for batch in batches:
            piece, at = (batch.column(i).to_numpy() for i in range(2))
            for k in np.unique(piece):
                seen.setdefault(int(k), np.zeros(PIECE, np.uint8))[at[piece == k]] = 1
        for k, x in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(x).tobytes()], pa.binary())], ["piece", "blob"])

    rows = rows.select(place(bits, *columns).alias("h")).distinct()
    rows = rows.select(F.expr(f"cast(h div {PIECE} as int)").alias("piece"), F.expr(f"cast(h % {PIECE} as int)").alias("at"))
    out = np.zeros(bits // 8, np.uint8)
    with shuffles_cleaned(rows.sparkSession):
        found = rows.repartition("piece").mapInArrow(run, "piece int, blob binary").collect()  # 16 MB at most
    for r in found:
        out[r[0] * PIECE // 8 : (r[0] + 1) * PIECE // 8] = np.frombuffer(r[1], np.uint8)
    return out


def filtered(df: DataFrame, sent, bits: int, columns: list[str], keep: bool = True) -> DataFrame:
    """The rows of df whose places are in a broadcast map, or are not."""

    def run(batches):
        for batch in batches:
            hit = within(sent.value, batch.column(batch.num_columns - 1).to_numpy())
            yield batch.select(range(batch.num_columns - 1)).filter(pa.array(hit if keep else ~hit))

    return df.select("*", place(bits, *columns).alias("__place")).mapInArrow(run, df.schema)
