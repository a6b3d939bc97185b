"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stevedore.session import scratch_path

#: Words are runs of anything but the six ASCII white-space characters.
WORD_RE = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new folder under the shared scratch root and read it back: cuts lineage,
    survives lost executors, and makes later passes see the same rows."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(*taken: Iterable[str]) -> str:
    """A column name that clashes with none of ``taken`` (names compare case-insensitively)."""
    used = {n.lower() for names in taken for n in names}
    while (name := f"_x{uuid.uuid4().hex[:10]}") in used:
        pass
    return name


def text_key(text: Column) -> Column:
    """64-bit key of a whole text. With ``doc_id`` it names a row; rows equal in both are alike, so
    every operator here gives them the same result."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


#: Bits of a key filter: 2 MB. More keys than bits let more through.
FILTER_BITS = 1 << 24


def filter_bit(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))


def key_filter(bits: DataFrame) -> np.ndarray:
    """The set of the ``bit`` column (below FILTER_BITS) as a bitmap: at most FILTER_BITS / 64 rows come to the driver,
    however many keys there are. It says which rows a later step certainly doesn't need."""
    words = bits.select(F.shiftright("bit", 6).alias("word"), F.col("bit").bitwiseAND(F.lit(63)).cast("int").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return out


def in_filter(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((bitmap[at >> 6] >> (at & 63)) & 1).astype(bool)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a slice holds about ``most`` bytes of ``column`` (one row at least):
    bounds a worker's memory however many long texts lie side by side."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < len(sizes):
            yield batch.slice(start)
    pa.default_memory_pool().release_unused()  # workers are kept for later tasks
