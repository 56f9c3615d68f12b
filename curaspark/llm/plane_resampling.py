"""Importance resampling towards a target text, with weights summed over bit planes.

Words of a document fall into buckets. The counts of its buckets are kept as bit planes: bit b of plane k is bit k of
the count of bucket b. The gain of every bucket is an integer, kept as two's complement planes the same way, the highest
one standing for the negative power. ANDing a count plane with a gain plane, counting the bits and adding powers of two
gives the sum of all gains exactly, with no multiplication per bucket.

Gains come from all documents and all target texts: every task adds its bucket counts in one vector and hands on one row
per bucket, so what is shuffled does not depend on the words. The draw keeps the highest scores by Gumbel noise from a
hash of the id. The score at the border comes from counts per score; only what is at or above it is sorted, by ranges.

Null texts have no words; documents without features weigh 0 and may not be drawn if they have too few words. A null id
hashes like an empty one and comes last among equal scores. Equal (score, id) rows rank by feature count, repeated rows
count as often as they occur. An empty table gives no rows, an empty target gives gains from the smoothing alone. Other
columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curaspark.llm.common import Memo, per_batch, slices, text_rows
from curaspark.scale import row_index
from curaspark.session import checkpoint

BUCKETS = 10_000
SALT = "2024"
#: Longest run of words that is a feature.
LONGEST = 1
#: Documents with fewer words are not drawn.
MIN_WORDS = 20

#: Bytes of letters and digits stay (A-Z as a-z), as does every byte beyond ASCII; the rest separates words.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of UTF-8 bytes with A-Z lower-cased; none for null."""
    return text.translate(_FOLD).split() if text else []


class Buckets:
    """Buckets of all features of a text; those of features seen before come from a bounded memo."""

    def __init__(self, buckets: int, longest: int):
        self.longest = longest
        self.memo = Memo(lambda feature: zlib.crc32(feature) % buckets)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        found = [np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))]
        for n in range(2, self.longest + 1):
            runs = (b" ".join(words[i : i + n]) for i in range(len(words) - n + 1))
            found.append(np.fromiter(map(self.memo.__getitem__, runs), np.int64))
        return np.concatenate(found)


# ------------------------------------------------------------------ bit planes


def planes_of(values: np.ndarray, bits: int) -> np.ndarray:
    """(bits, words) planes of the lowest ``bits`` bits of integers, 64 positions to a word."""
    width = -(-len(values) // 64) * 8
    out = np.zeros((bits, width), np.uint8)
    for k in range(bits):
        packed = np.packbits(((values >> k) & 1).astype(np.uint8), bitorder="little")
        out[k, : len(packed)] = packed
    return out.view(np.uint64)


def signed_planes(gains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two's complement planes of the gains and the power of two (the last one negative) that each stands for."""
    low, high = int(gains.min(initial=0)), int(gains.max(initial=0))
    bits = 1 + max(high.bit_length(), (~low).bit_length())
    powers = [1 << k for k in range(bits - 1)] + [-(1 << (bits - 1))]
    return planes_of(gains, bits), np.array(powers, np.int64)


def plane_sum(counts: np.ndarray, gains: np.ndarray, powers: np.ndarray) -> int:
    """Sum over all positions of count times gain, from their planes."""
    met = np.bitwise_count(counts[:, None, :] & gains[None, :, :]).sum(axis=2, dtype=np.int64)
    return sum((1 << k) * int(row @ powers) for k, row in enumerate(met))


# ------------------------------------------------------------------ gains


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """(bucket, n): features of all texts by bucket; buckets without any are missing."""
    schema = pa.schema([("bucket", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, total = Buckets(buckets, longest), np.zeros(buckets, np.int64)
        for part in slices(batches):
            for t in part.column(0).to_pylist():
                total += np.bincount(find(words_of(t)), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], schema=schema)

    rows = texts.select(F.col(text).cast("binary").alias("_text")).mapInArrow(count, "bucket bigint, n bigint")
    return rows.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """(bucket, gain) of every bucket: floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))) in doubles."""
    spark = docs.sparkSession
    seen = bucket_counts(docs, text, buckets, longest).select("bucket", F.col("n").alias("s"), F.lit(0).cast("bigint").alias("t"))
    wanted = bucket_counts(target, text, buckets, longest).select("bucket", F.lit(0).cast("bigint").alias("s"), F.col("n").alias("t"))
    every = spark.range(buckets).select(F.col("id").alias("bucket"), F.lit(0).cast("bigint").alias("s"), F.lit(0).cast("bigint").alias("t"))
    table = checkpoint(seen.unionByName(wanted).unionByName(every).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")))
    all_s, all_t = table.agg(F.sum("s"), F.sum("t")).first()
    s, t = F.col("s").cast("double"), F.col("t").cast("double")
    ratio = ((t + 1) * F.lit(float(all_s + buckets))) / ((s + 1) * F.lit(float(all_t + buckets)))
    return table.select("bucket", F.floor(F.lit(1000.0) * F.ln(ratio)).alias("gain"))


# ------------------------------------------------------------------ weights, scores, draw


def weights(docs: DataFrame, gained: DataFrame, ident: str = "doc_id", text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """(ident, n_words, n_features, weight): the floored mean gain of the features of every whole text."""
    table = np.zeros(buckets, np.int64)
    for row in gained.collect():  # one row per bucket, a fixed number
        table[row["bucket"]] = row["gain"]
    shared = docs.sparkSession.sparkContext.broadcast(signed_planes(table))
    find = Buckets(buckets, longest)

    def make(columns: list[list]) -> list[list]:
        gain_planes, powers = shared.value
        ids, texts = columns
        out: list[list] = [ids, [], [], []]
        for t in texts:
            words = words_of(t)
            found = find(words)
            weight = 0
            if len(found):
                counts = np.bincount(found, minlength=buckets)
                weight = plane_sum(planes_of(counts, int(counts.max()).bit_length()), gain_planes, powers) // len(found)
            out[1].append(len(words))
            out[2].append(len(found))
            out[3].append(weight)
        return out

    kind = docs.schema[ident].dataType.simpleString()
    return per_batch(text_rows(docs, ident, text), make, f"`{ident}` {kind}, n_words bigint, n_features bigint, weight bigint")


def noise(ident: Column, salt: str = SALT) -> Column:
    """Gumbel noise in thousandths, from the first 8 hexadecimal digits of a hash of the id."""
    key = F.concat(F.lit(f"{salt}:"), F.coalesce(ident.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))


def resampled(
    docs: DataFrame, target: DataFrame, percent: int = 10, ident: str = "doc_id", text: str = "text",
    buckets: int = BUCKETS, longest: int = LONGEST, min_words: int = MIN_WORDS, salt: str = SALT,
) -> DataFrame:
    """(ident, n_words, n_features, weight, score, rank): ``percent`` of the long enough documents are drawn and ranked.

    Rank is 1, 2, 3... from the highest score, ties to the smaller id; it is null where a document is not drawn.
    """
    weighed = weights(docs, gains(docs, target, text, buckets, longest), ident, text, buckets, longest)
    scored = checkpoint(weighed.withColumn("score", F.col("weight") + noise(F.col(ident), salt)))
    fit = F.col("n_words") >= min_words
    # whole numbers between the extremes of gain and noise: fewer than 100,000 different scores, however many documents
    steps = [(r["score"], r["n"]) for r in scored.filter(fit).groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()]
    draw = percent * sum(n for _, n in steps) // 100
    border, above = None, 0
    for score, n in sorted(steps, reverse=True):
        if above >= draw:
            break
        border, above = score, above + n
    unranked = scored.withColumn("rank", F.lit(None).cast("bigint"))
    if border is None:
        return unranked
    reached = fit & (F.col("score") >= border)
    order = [F.desc("score"), F.asc_nulls_last(ident), F.asc("n_features"), F.asc("n_words")]
    ranked = row_index(scored.filter(reached), order, "_at")
    ranked = ranked.withColumn("rank", F.when(F.col("_at") < draw, F.col("_at") + 1)).drop("_at")
    return ranked.unionByName(unranked.filter(~reached))
