"""Log-bilinear language model trained in numpy by noise-contrastive estimation.

A word is predicted from the two words before it: the context vector is the sum of a vector for each of the two, and
a word's score its product with that vector plus a bias. The sums of exponentials over the whole vocabulary are
computed once for every context, by batched matrix products, so that scores are normalised log-probabilities.

Words are counted exactly, by a shuffle. The vocabulary grows with the cube root of the training tokens, the second
context with the cube root of the vocabulary, the list of words with numbers of their own (``frequent``) with its
square root (``Shape.of``). Texts become arrays of word numbers, dealt to shards of equal size (tokens in proportion to
the parameters) whatever the files look like. Shards are trained in ``ROUNDS`` rounds; each starts from the average of
the copies of the round before, weighted by their tokens, with the averages of their step sizes.

Words outside the model's vocabulary are predicted by their class (a hash of the last two bytes) and then by their
smoothed share of the class. Words outside the list meet their counts in a join. Collected and broadcast are the list,
the averaged model and the sums of exponentials: none grows faster than the cube root of the tokens, times the second context.

A null or empty text is one end token. A null id is never held out. Repeated rows are scored alike and counted each.
Other columns are not read, so their names may clash with anything. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curaspark.llm.common import MEMO_SIZE, Memo, per_batch, slices
from curaspark.session import checkpoint

#: Words of the model for each cube root of the training tokens; classes of other words; numbers in a vector.
PER_ROOT, CLASSES, DIM = 16, 64, 24
NEAR_CLASSES = 32
#: Training tokens of a shard for each parameter of the model, and rounds of training.
TOKENS_PER_NUMBER, ROUNDS = 5, 3
#: Tokens of a step, tokens shuffled together, noise words of a step, step size, and squared gradients that a row starts with.
STEP_TOKENS, CHUNK, NOISE, RATE, POWER = 1024, 1 << 18, 100, 0.05, 1e-5
SMOOTH = 0.1
SEED = 17


@dataclass(frozen=True)
class Shape:
    """Words of the model, words that are known two places back, words with numbers of their own."""

    words: int
    near: int
    frequent: int

    @classmethod
    def of(cls, tokens: int, distinct: int) -> Shape:
        words = min(distinct, math.ceil(PER_ROOT * tokens ** (1 / 3)))
        return cls(words, min(words, math.ceil(2 * words ** (1 / 3))), min(distinct, max(words, math.ceil(2048 * math.sqrt(words)))))

    @property
    def end(self) -> int:
        return self.words

    @property
    def outputs(self) -> int:
        """Words, end of text, classes; first contexts are numbered alike, with the start of a text in place of its end."""
        return self.words + 1 + CLASSES

    @property
    def second(self) -> int:
        return self.near + 1 + NEAR_CLASSES

    @property
    def tables(self) -> list[tuple]:
        return [(self.outputs, DIM), (self.second, DIM), (self.outputs, DIM), (self.outputs,)]

    @property
    def shard_tokens(self) -> int:
        return TOKENS_PER_NUMBER * 2 * DIM * self.outputs


def word_class(word: bytes, classes: int = CLASSES) -> int:
    return zlib.crc32(word[-2:]) % classes


def tokens(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


class Numbers:
    """The number of a word: its place in the list; after the list the end of a text, then the classes of all other words."""

    def __init__(self, listed: list[bytes]):
        self.place = {w: i for i, w in enumerate(listed)}
        self.end = len(listed)
        self.memo = Memo(self._number)

    def _number(self, word: bytes) -> int:
        at = self.place.get(word)
        return self.end + 1 + word_class(word) if at is None else at

    def of(self, words: list[bytes]) -> np.ndarray:
        out = np.empty(len(words) + 1, np.int32)
        out[:-1] = np.fromiter(map(self.memo.__getitem__, words), np.int32, len(words))
        out[-1] = self.end
        return out


class Reading:
    """Outputs and contexts of arrays of word numbers that each end with the end of a text."""

    def __init__(self, shape: Shape, listed: list[bytes]):
        n = len(listed)
        kinds = np.array([word_class(w) for w in listed] + [0] + list(range(CLASSES)), np.int64)
        number = np.arange(n + 1 + CLASSES)
        self.out = np.where(number < shape.words, number, shape.words + 1 + kinds)
        self.out[n] = shape.end
        self.second = np.where(number < shape.near, number, shape.near + 1 + kinds % NEAR_CLASSES)
        self.second[n] = shape.near
        self.end = n

    def of(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(outputs, first contexts, second contexts): before a text stand two starts."""
        before = np.empty_like(code)
        before[:1], before[1:] = self.end, code[:-1]
        twice = np.empty_like(code)
        twice[:1], twice[1:] = self.end, before[:-1]
        twice = np.where(before == self.end, self.end, twice)
        return self.out[code], self.out[before], self.second[twice]


# ------------------------------------------------------------------ the model


class Model:
    """Parameters: vectors of first and second contexts, vectors and biases of outputs."""

    def __init__(self, tables: list[np.ndarray]):
        self.tables = tables

    @classmethod
    def fresh(cls, shape: Shape, unigram: np.ndarray) -> Model:
        rng = np.random.default_rng(SEED)
        tables = [(rng.standard_normal(s) * 0.1).astype(np.float32) for s in shape.tables[:3]]
        return cls([*tables, np.log(unigram).astype(np.float32)])

    @classmethod
    def unpacked(cls, flat: np.ndarray, shape: Shape) -> Model:
        return cls(_unpacked(flat, shape.tables))


def _packed(tables: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([t.ravel() for t in tables]).astype(np.float32)


def _unpacked(flat: np.ndarray, shapes: list[tuple]) -> list[np.ndarray]:
    ends = np.cumsum([math.prod(s) for s in shapes])[:-1]
    return [part.reshape(s).astype(np.float32) for part, s in zip(np.split(flat, ends), shapes)]


def _add_rows(table: np.ndarray, power: np.ndarray, rows: np.ndarray, grad: np.ndarray) -> None:
    """One adaptive step on the rows that occur; the gradients of a row are summed first."""
    # short keys are sorted by digits
    order = np.argsort(rows.astype(np.uint16) if len(table) < 1 << 16 else rows, kind="stable")
    sorted_rows = rows[order]
    starts = np.flatnonzero(np.r_[True, sorted_rows[1:] != sorted_rows[:-1]])
    total = np.add.reduceat(grad[order], starts, axis=0)
    which = sorted_rows[starts]
    power[which] += (total * total).mean(axis=1) if total.ndim == 2 else total * total
    scale = np.float32(RATE) / np.sqrt(power[which] + np.float32(1e-12))
    table[which] -= total * (scale[:, None] if total.ndim == 2 else scale)


def _odds(raw: np.ndarray) -> np.ndarray:
    """The logistic function, in place."""
    np.clip(raw, -30, 30, out=raw)
    np.negative(raw, out=raw)
    np.exp(raw, out=raw)
    raw += 1
    return np.reciprocal(raw, out=raw)


class Trainer:
    """Noise-contrastive steps of one shard, from a packed state or from the start."""

    def __init__(self, shape: Shape, unigram: np.ndarray, state: np.ndarray | None = None, seed: int = SEED):
        powers = [(t[0],) for t in shape.tables]
        if state is None:
            self.tables = Model.fresh(shape, unigram).tables
            self.power = [np.full(p, POWER, np.float32) for p in powers]
        else:
            all_tables = _unpacked(state, [*shape.tables, *powers])
            self.tables, self.power = all_tables[:4], all_tables[4:]
        self.noise_log = np.log(NOISE * unigram).astype(np.float32)
        self.cumulative = np.cumsum(unigram)
        self.rng = np.random.default_rng(seed)

    def packed(self) -> np.ndarray:
        return _packed([*self.tables, *self.power])

    def step(self, out: np.ndarray, first: np.ndarray, second: np.ndarray) -> None:
        c1, c2, q, bias = self.tables
        noise = np.searchsorted(self.cumulative, self.rng.random(NOISE) * self.cumulative[-1])
        noise = np.minimum(noise, len(bias) - 1)
        context = c1[first]
        context += c2[second]
        qw, qn = q[out], q[noise]
        g = _odds(np.einsum("ij,ij->i", context, qw) + (bias[out] - self.noise_log[out]))
        g -= 1
        other = context @ qn.T
        other += bias[noise] - self.noise_log[noise]
        h = _odds(other)
        to_context = h @ qn
        to_context += g[:, None] * qw
        rows = np.concatenate([out, noise])
        context_sums = h.T @ context
        context *= g[:, None]
        _add_rows(q, self.power[2], rows, np.concatenate([context, context_sums]))
        _add_rows(bias, self.power[3], rows, np.concatenate([g, h.sum(axis=0)]))
        _add_rows(c1, self.power[0], first, to_context)
        _add_rows(c2, self.power[1], second, to_context)

    def learn(self, out: np.ndarray, first: np.ndarray, second: np.ndarray) -> None:
        order = self.rng.permutation(len(out))
        for i in range(0, len(out), STEP_TOKENS):
            some = order[i : i + STEP_TOKENS]
            self.step(out[some], first[some], second[some])


def log_sums(model: Model, first: np.ndarray) -> np.ndarray:
    """Natural logarithms of the sums of exponentials, for all second contexts of some first ones: one matrix product."""
    c1, c2, q, bias = model.tables
    raw = (c1[first][:, None, :] + c2[None, :, :]).reshape(-1, DIM) @ q.T
    raw += bias
    top = raw.max(axis=1, keepdims=True)
    raw -= top
    np.exp(raw, out=raw)
    return (top[:, 0] + np.log(raw.sum(axis=1))).reshape(len(first), len(c2))


# ------------------------------------------------------------------ tables


def _rows(docs: DataFrame, ident: str, text: str) -> DataFrame:
    held = F.coalesce(F.crc32(F.col(ident).cast("string")) % 10 == 0, F.lit(False))
    return docs.select(F.col(ident).alias("id"), F.col(text).cast("binary").alias("text"), held.alias("held"), F.xxhash64(ident, text).alias("rid"))


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, n): exact counts of all training words. A task adds up the words of its texts as long as its table has room."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())], ["word", "n"])

        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                found.update(tokens(text))
            if len(found) > MEMO_SIZE:
                yield out()
                found.clear()
        if found:
            yield out()

    each = rows.filter("not held").select("text").mapInArrow(count, "word binary, n bigint")
    return checkpoint(each.groupBy("word").agg(F.sum("n").alias("n")))


def most_frequent(counts: DataFrame, size: int) -> list[tuple[bytes, int]]:
    """The ``size`` most frequent words, ties by their bytes. Words are first counted by classes of counts, so few are sorted."""
    level = F.floor(F.log2("n") * 8)
    per_level = sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True)  # at most 8 rows for a doubling
    low, so_far = 0, 0
    for r in per_level:
        low, so_far = r["level"], so_far + r["count"]
        if so_far >= size:
            break
    top = counts.filter(level >= low).orderBy(F.desc("n"), "word").limit(size)
    return [(bytes(r["word"]), r["n"]) for r in top.collect()]


def encoded(rows: DataFrame, listed) -> DataFrame:
    """(id, held, rid, codes): every text as the numbers of its words and its end, 32 bits each. ``listed``: broadcast words."""
    kind = rows.schema["id"].dataType.simpleString()

    def make(columns: list[list]) -> list[list]:
        numbers = _numbers(listed)
        return [*columns[:3], [numbers.of(tokens(t)).tobytes() for t in columns[3]]]

    return checkpoint(per_batch(rows.select("id", "held", "rid", "text"), make, f"id {kind}, held boolean, rid bigint, codes binary"))


_NUMBERS: dict[int, Numbers] = {}


def _numbers(listed) -> Numbers:
    """One table of words in a worker process."""
    if listed.id not in _NUMBERS:
        _NUMBERS.clear()
        _NUMBERS[listed.id] = Numbers(listed.value)
    return _NUMBERS[listed.id]


class _Key:
    """A broadcast value and a name for it that lasts through pickling."""

    def __init__(self, broadcast, name: str):
        self.broadcast, self.id = broadcast, name

    @property
    def value(self):
        return self.broadcast.value


def train(codes: DataFrame, shape: Shape, listed, unigram: np.ndarray, training: int) -> np.ndarray:
    """The packed state of the model after all rounds over ``codes``; ``training`` is the number of training tokens."""
    spark = codes.sparkSession
    shards = max(1, round(training / ROUNDS / shape.shard_tokens))
    part = F.pmod(F.xxhash64("rid", F.lit(SEED)), F.lit(ROUNDS))
    state = None
    for n in range(ROUNDS):
        before = spark.sparkContext.broadcast(state)

        def learn(batches: Iterator[pa.RecordBatch], before=before, n=n) -> Iterator[pa.RecordBatch]:
            reading = Reading(shape, listed.value)
            trainer, seen, waiting, room = None, 0, [], 0

            def flush() -> None:
                trainer.learn(*reading.of(np.concatenate(waiting)))

            for batch in slices(batches):
                for code in batch.column(0):
                    trainer = trainer or Trainer(shape, unigram, before.value, SEED + n)
                    waiting.append(np.frombuffer(code.as_buffer(), np.int32))
                    room += len(waiting[-1])
                    if room >= CHUNK:
                        flush()
                        seen, waiting, room = seen + room, [], 0
            if waiting:
                flush()
                seen += room
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([seen]), pa.array([trainer.packed().tobytes()], pa.binary())], ["n", "state"])

        def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, mean = 0, 0.0
            for batch in batches:
                for weight, flat in zip(*(c.to_pylist() for c in batch.columns)):
                    mean = mean + weight * np.frombuffer(flat, np.float32).astype(np.float64)
                    total += weight
            if total:
                yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([(mean / total).astype(np.float32).tobytes()], pa.binary())], ["n", "state"])

        # rows alike are spread as well, since the place of a row is part of its key
        some = codes.filter(~F.col("held") & (part == n)).select("codes", "rid", F.xxhash64("rid", F.monotonically_increasing_id()).alias("key"))
        dealt = some.repartition(shards, "key").sortWithinPartitions("rid").select("codes")
        copies = checkpoint(dealt.mapInArrow(learn, "n bigint, state binary"))
        left = copies.count()
        while left > 1:  # copies are averaged 32 at a time, streamed through each task
            left = -(-left // 32)
            copies = checkpoint(copies.repartition(left).mapInArrow(average, "n bigint, state binary"))
            left = copies.count()
        row = copies.first()
        if row is not None:
            state = np.frombuffer(bytes(row["state"]), np.float32)
    return Trainer(shape, unigram).packed() if state is None else state


def rare_words(rows: DataFrame, listed, counts: DataFrame) -> DataFrame:
    """(rid, logs, known): sums of every text over its words that are not listed. Rows alike count each, but are scored once."""

    def make(columns: list[list]) -> list[list]:
        place = _numbers(listed).place
        words, rids, often = [], [], []
        for text, rid in zip(*columns):
            found = Counter(w for w in tokens(text) if w not in place)
            words += map(_word_hash, found)
            often += found.values()
            rids += [rid] * len(found)
        return [words, rids, often]

    found = per_batch(rows.select("text", "rid"), make, "h bigint, rid bigint, m int")
    # a word outside the list has a bounded share of all tokens; adaptive execution splits what is still too large
    known = counts.select(F.xxhash64("word").alias("h"), "n").groupBy("h").agg(F.sum("n").alias("n"))
    met = found.join(known, "h", "left")
    logs = F.col("m") * F.log10(F.coalesce("n", F.lit(0)) + SMOOTH)
    per_row = met.groupBy("rid", "h").agg(F.max(logs).alias("logs"), F.max(F.when(F.col("n") > 0, F.col("m")).otherwise(0)).alias("known"))
    return per_row.groupBy("rid").agg(F.sum("logs").alias("logs"), F.sum("known").alias("known"))


def _word_hash(word: bytes) -> int:
    """What xxhash64 gives for a binary column."""
    h = xxhash.xxh64_intdigest(word, 42)
    return h - (1 << 64) if h >> 63 else h


def class_of(word: str) -> F.Column:
    """``word_class`` of a binary column."""
    return F.crc32(F.expr(f"substring({word}, -2, 2)")) % CLASSES


def scores(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(ident, held_out, n_tokens, n_known, train_tokens, base_score, score) of every whole text."""
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    rows = _rows(docs, ident, text)
    texts = rows.filter("not held").count()
    counts = word_counts(rows)
    class_n, class_v = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in counts.groupBy(class_of("word").alias("k")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():  # a row for each class
        class_n[r["k"]], class_v[r["k"]] = r["n"], r["v"]
    all_n, all_v = int(class_n.sum()) + texts, int(class_v.sum()) + (texts > 0)
    shape = Shape.of(all_n, int(class_v.sum()))

    frequent = most_frequent(counts, shape.frequent)
    own = np.array([n for _, n in frequent], np.float64)
    for w, n in frequent[: shape.words]:
        class_n[word_class(w)] -= n
        class_v[word_class(w)] -= 1
    listed = _Key(share([w for w, _ in frequent]), f"{spark.sparkContext.applicationId} {id(frequent)} {all_n}")
    unigram = np.concatenate([own[: shape.words], [texts], class_n]) + 1
    unigram /= unigram.sum()

    codes = encoded(rows, listed)
    state = train(codes, shape, listed, unigram, all_n)
    size = sum(math.prod(s) for s in shape.tables)
    model = share(state[:size].copy())

    def sums(columns: list[list]) -> list[list]:
        m = Model.unpacked(model.value, shape)
        # some contexts at a time: a few million numbers
        some = max(1, (1 << 22) // (shape.second * shape.outputs))
        parts = [log_sums(m, np.array(columns[0][i : i + some])) for i in range(0, len(columns[0]), some)]
        return [columns[0], [r.astype(np.float32).tobytes() for p in parts for r in p]]

    blocks = spark.range(0, shape.outputs, 1, max(8, shape.outputs // 256))
    table = np.zeros((shape.outputs, shape.second), np.float32)
    for r in per_batch(blocks, sums, "id bigint, logs binary").collect():  # the table that is broadcast
        table[r["id"]] = np.frombuffer(r["logs"], np.float32)
    normal = share(table)

    # by word number; the counts of classes' words that are not listed come with the join
    none = np.zeros(CLASSES)
    logs = np.concatenate([np.log10(own + SMOOTH), [np.log10(texts + SMOOTH)], none])
    known = np.concatenate([own > 0, [texts > 0], none])
    # of words of a class: their share of it
    class_log = np.log10(class_n + SMOOTH * (class_v + 1))
    base_log = float(np.log10(all_n + SMOOTH * (all_v + 1)))

    def make(columns: list[list]) -> list[list]:
        reading = Reading(shape, listed.value)
        c1, c2, q, bias = Model.unpacked(model.value, shape).tables
        within = np.where(reading.out > shape.end, logs - class_log[np.maximum(reading.out - shape.end - 1, 0)], 0.0)
        columns_out: list[list] = [[], [], [], []]
        for i in range(0, len(columns[0]), 500):
            texts_here = [np.frombuffer(c, np.int32) for c in columns[3][i : i + 500]]
            code = np.concatenate(texts_here)
            starts = np.r_[0, np.cumsum([len(t) for t in texts_here])[:-1]]
            out, first, second = reading.of(code)
            got = within[code]
            for j in range(0, len(code), 1 << 15):
                s = slice(j, j + (1 << 15))
                context = c1[first[s]]
                context += c2[second[s]]
                raw = np.einsum("ij,ij->i", context, q[out[s]]) + bias[out[s]] - normal.value[first[s], second[s]]
                got[s] += raw / np.log(10)
            columns_out[0] += [len(t) for t in texts_here]
            for c, x in zip(columns_out[1:], (known[code], logs[code], got)):
                c.append(np.add.reduceat(x, starts))
        return [*columns[:3], columns_out[0], *(np.concatenate(c) if c else [] for c in columns_out[1:])]

    kind = docs.schema[ident].dataType.simpleString()
    schema = f"id {kind}, held boolean, rid bigint, n bigint, known_usual double, base double, lm double"
    done = per_batch(codes, make, schema).join(rare_words(rows, listed, counts), "rid", "left")
    rare_logs = F.coalesce("logs", F.lit(0.0))
    return done.select(
        F.col("id").alias(ident), F.col("held").alias("held_out"), F.col("n").alias("n_tokens"),
        (F.col("known_usual") + F.coalesce("known", F.lit(0))).cast("bigint").alias("n_known"),
        F.lit(all_n).cast("bigint").alias("train_tokens"),
        (F.col("base") + rare_logs - F.col("n") * F.lit(base_log)).alias("base_score"),
        (F.col("lm") + rare_logs).alias("score"),
    )
