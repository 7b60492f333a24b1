"""A broadcast bit filter of 64-bit keys, of bounded size: it passes all keys that were put in and a few others."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchgrain.llm.textbytes import U, mix

#: Most bits of a broadcast filter It has 16 to 32 bits for each; beyond, more keys pass than need to, and the exact joins behind it do the rest.
FILTER_BITS = 1 << 28


class Filter:
    """A bit filter of 64-bit keys: two bits each."""

    def __init__(self, keys: DataFrame, bits: int = FILTER_BITS) -> None:
        """``keys`` has one long column; Spark gathers the set bits, and at most ``bits`` of them reach the driver."""
        wanted = max(64, keys.count() * 16)
        self.bits = min(1 << (wanted - 1).bit_length(), bits)
        words = np.zeros(self.bits // 64, np.uint64)

        def masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bit = np.concatenate(self.places(batch.column(0).to_numpy(zero_copy_only=False).view(U)))
                yield pa.RecordBatch.from_arrays([pa.array((bit >> U(6)).astype(np.int64)), pa.array((U(1) << (bit & U(63))).view(np.int64))], names=["word", "mask"])

        got = keys.mapInArrow(masks, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
        words[got.column("word").to_numpy()] = got.column("mask").to_numpy().view(U)
        self.shared = keys.sparkSession.sparkContext.broadcast(words)

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = mix(keys)
        return keys % U(self.bits), (keys >> U(32)) % U(self.bits)

    def __getstate__(self) -> dict:
        return {"bits": self.bits, "shared": self.shared} if "shared" in self.__dict__ else {"bits": self.bits}

    def passes(self, keys: np.ndarray) -> np.ndarray:
        words = self.shared.value
        return np.logical_and(*((words[bit >> U(6)] >> (bit & U(63))) & U(1) > 0 for bit in self.places(keys)))

    def column(self, key: Column) -> Column:
        """Whether a long column's keys pass."""

        def passing(keys: pd.Series) -> pd.Series:
            return pd.Series(self.passes(keys.to_numpy().view(U)))

        return F.pandas_udf(passing, "boolean")(key)
