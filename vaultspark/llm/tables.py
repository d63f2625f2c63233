"""Arrays of counts or bits that tasks build and that are merged in bounded groups."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that one merging task holds of a slice.
FAN_IN = 128


def packed(x: np.ndarray) -> bytes:
    return zlib.compress(x.tobytes(), 1)


def unpacked(b: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zlib.decompress(b), kind)


def merged(parts: DataFrame, combine: Callable[[Iterator[bytes]], bytes], tasks: int) -> DataFrame:
    """(slice, payload) rows of ``tasks`` tasks, merged to one for each slice, FAN_IN at a time."""

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"slice": frame["slice"].iloc[:1], "part": frame["part"].iloc[:1], "payload": [combine(iter(frame["payload"]))]})

    out = parts.select("slice", F.spark_partition_id().alias("part"), "payload")
    while tasks > 1:
        tasks = -(-tasks // FAN_IN)
        kind = out.schema["slice"].dataType.simpleString()
        out = out.withColumn("part", F.expr(f"cast(pmod(part, {tasks}) as int)")).groupBy("slice", "part").applyInPandas(merge, f"slice {kind}, part int, payload binary")
    return out.select("slice", "payload")
