"""A set of 64-bit hashes as a bit field of fixed size: may say yes too often, never no."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 24


@dataclass(frozen=True)
class Bits:
    """2^24 bits (2 MB) whatever the number of hashes, so it can go along with every task.
    When it fills up it only lets more rows through to the exact join behind it."""

    field: np.ndarray

    @staticmethod
    def of(hashes: DataFrame, column: str) -> Bits:
        """The words of the field come from an aggregate, so 2^18 rows arrive at most."""
        found = (
            hashes.select(
                F.expr(f"shiftright(`{column}` & {(1 << BITS) - 1}L, 6)").alias("word"),
                F.expr(f"shiftleft(1L, cast(`{column}` & 63L as int))").alias("bit"),
            )
            .groupBy("word")
            .agg(F.bit_or("bit").alias("bits"))
            .toPandas()
        )
        field = np.zeros(1 << (BITS - 6), np.int64)
        field[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
        return Bits(field.view(np.uint8))

    def has(self, hashes: np.ndarray) -> np.ndarray:
        place = hashes.astype(np.int64) & (8 * len(self.field) - 1)
        return (self.field[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1

    def may_hold(self, hashes: Column) -> Column:
        """False for rows that are certainly not in the set; they need no join with it."""

        @F.pandas_udf("boolean")
        def held(values: pd.Series) -> pd.Series:
            return pd.Series(self.has(values.to_numpy(np.int64)))

        return held(hashes)
