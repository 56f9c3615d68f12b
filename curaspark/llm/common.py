"""Arrow helpers shared by the operators: rows of texts in, columns out, words and their hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries a process keeps in one of its memo tables before it starts afresh.
MEMO_SIZE = 400_000

#: Rows that are turned into Python objects at a time.
AT_ONCE = 1000

MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)
STEP = np.uint64(0x9E3779B97F4A7C15)


class Memo(dict):
    """A dict that computes missing values and starts afresh when it is full, so memory stays bounded."""

    def __init__(self, compute: Callable, size: int = MEMO_SIZE):
        super().__init__()
        self.compute = compute
        self.size = size

    def __missing__(self, key):
        if len(self) >= self.size:
            self.clear()
        value = self[key] = self.compute(key)
        return value



def lowered_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 bytes with A-Z lower-cased; none for null."""
    return text.lower().split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words; a table of known words costs twice the time of hashing them again."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on every other."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words; a shorter non-empty sequence gives one hash of the whole."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(width, n)
    out = np.full(n - width + 1, width, np.uint64)
    for j in range(width):
        out = out * STEP + hashes[j : n - width + 1 + j]
    return mix(out)


def batch_windows(texts: list[bytes | None], width: int) -> list[np.ndarray]:
    """``window_hashes`` of the lower-cased words of every text, computed for many texts at once."""
    out: list[np.ndarray] = []
    for i in range(0, len(texts), 256):
        words = [lowered_words(t) for t in texts[i : i + 256]]
        sizes = [len(w) for w in words]
        hashes = np.concatenate([word_hashes(w) for w in words]) if words else np.zeros(0, np.uint64)
        n = len(hashes)
        all_runs = np.full(max(0, n - width + 1), width, np.uint64)
        for j in range(width if n >= width else 0):
            all_runs *= STEP
            all_runs += hashes[j : n - width + 1 + j]
        all_runs = mix(all_runs)
        at = 0
        for size in sizes:
            out.append(all_runs[at : at + size - width + 1] if size >= width else window_hashes(hashes[at : at + size], width))
            at += size
    return out


def text_rows(docs: DataFrame, ident: str = "doc_id", text: str = "text", more: Iterable = ()) -> DataFrame:
    """(ident, text, more...) and nothing else, whatever other columns the table has."""
    return docs.select(F.col(ident), F.col(text).cast("binary").alias("_text"), *more)


def slices(batches: Iterator[pa.RecordBatch], at_once: int = AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Batches cut to at most ``at_once`` rows."""
    for batch in batches:
        for i in range(0, batch.num_rows, at_once):
            yield batch.slice(i, at_once)


def per_batch(rows: DataFrame, make: Callable[[list[list]], list], schema: str, at_once: int = AT_ONCE) -> DataFrame:
    """Apply ``make`` to the columns (as lists) of at most ``at_once`` rows; it returns the output columns.

    Spark streams the batches of a partition, so a task holds one batch at a time.
    """
    arrow = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, at_once):
            columns = make([c.to_pylist() for c in part.columns])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow.types)], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    spark_schema = StructType.fromDDL(schema)
    arrow = to_arrow_schema(spark_schema)
    return rows.mapInArrow(run, spark_schema)
