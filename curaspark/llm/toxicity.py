"""Toxicity by a weighted finite-state grammar over clauses.

Words of a clause become symbols: insult, threat, target, negation, reporting verb, quotation mark, other. Three
transducers - negation scope, reported speech, target - mark the insults and threats that pass through them, and are
composed into one automaton; a document is scored from the weights of its matched clauses by kind of match, so a
negated or quoted insult counts as what the labels say it is worth, not as an isolated word.

What is learned, all from labelled rows of the training part: the insults themselves (words or stems that single out toxic
documents, chosen one after another by the toxic documents they newly cover, so that words which merely occur in
copies of a toxic document are not taken), their weights, and a logistic regression over the kinds of match. It is fitted on at most
``TRAIN_ROWS`` labelled rows; every text is scored. Fixed lists are the starting point where labels are few.

Null and empty texts match nothing and get the score of a document without matches. Rows are independent. Labels
that are null are not used; of several labels of a document the larger counts.
"""

from __future__ import annotations

import math
import re

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curaspark.llm.common import per_batch, text_rows
from curaspark.session import checkpoint

#: Labelled rows that the model is fitted on at most (those with the smallest hashes), and terms that are looked at.
TRAIN_ROWS, MOST_TERMS = 20_000, 50_000
#: A learned term stands in so many toxic documents at least, is so many times likelier in them, and stands in more of
#: them than chance would put there by so many standard deviations.
LEAST_TOXIC, LEAST_RATIO, LEAST_SIGMAS = 3, 5.0, 6.0
#: Lengths of stems that are tried besides whole words.
STEMS = range(4, 9)
#: Score from which a document is called toxic.
THRESHOLD = 0.3

# Word lists of the grammar.
INSULTS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown")
THREATS = ("kill", "murder", "strangle", "shoot", "stab", "hurt", "destroy", "burn", "hang", "beat")
TARGETS = frozenset("you your yours u he she they them him her his their those these people everyone du dich dir ihr sie tu te toi vous ils elles usted ustedes tú ellos ellas".split())
NEGATIONS = frozenset("not no never neither nor isn't aren't wasn't don't doesn't didn't cannot can't nicht kein keine nie pas jamais nunca jamás tampoco".split())
REPORTS = frozenset("said says say called calls wrote writes quoted claimed reported told sagte sagt schrieb nannte dit écrit dijo dice escribió llamó".split())
QUOTES = frozenset('"“”«»„')

_CLAUSE = re.compile(r"[.!?;\n]+")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[\"“”«»„]")

# ------------------------------------------------------------------ the grammar

KINDS = ("i", "t")
ALPHABET = ("o", "g", "n", "r", "q", *KINDS)


class Transducer:
    """A deterministic transducer: ``arcs[state, symbol]`` is (next state, symbol put out); state 0 starts a clause."""

    def __init__(self, arcs: dict):
        self.arcs = arcs

    def then(self, other: Transducer) -> Transducer:
        """Composition: what this one puts out is read by the other. States are numbered as they are reached."""
        inputs = {s for _, s in self.arcs}
        numbers, todo, arcs = {(0, 0): 0}, [(0, 0)], {}
        while todo:
            pair = todo.pop()
            for symbol in inputs:
                a, middle = self.arcs[pair[0], symbol]
                b, out = other.arcs[pair[1], middle]
                if (a, b) not in numbers:
                    numbers[a, b] = len(numbers)
                    todo.append((a, b))
                arcs[numbers[pair], symbol] = (numbers[a, b], out)
        return Transducer(arcs)

    def run(self, symbols: list[str]) -> list[str]:
        state, out = 0, []
        for s in symbols:
            state, put = self.arcs[state, s]
            out.append(put)
        return out


def scope(opener: str, length: int, mark: str, inputs: tuple[str, ...], back: str | None = None) -> Transducer:
    """Marks matches that come at most ``length`` symbols after ``opener``; ``back`` ends the scope early."""
    arcs = {}
    for state in range(length + 1):
        for s in inputs:
            if s == opener:
                after = length
            elif s == back:
                after = 0
            else:
                after = max(0, state - 1)
            arcs[state, s] = (after, s + mark if state and s[0] in KINDS else s)
    return Transducer(arcs)


def grammar() -> Transducer:
    """Negation (three words), reporting verb or opening quotation mark (eight words, or to the closing mark), target (five words)."""
    plain = ALPHABET
    negated = (*plain, *(k + "-" for k in KINDS))
    said = (*negated, *(s + "r" for s in negated if s[0] in KINDS))
    return scope("n", 3, "-", plain).then(scope("r", 8, "r", negated, back="q")).then(scope("g", 5, "@", said))


#: Kinds of match: insult or threat, negated, reported, aimed at someone.
FEATURES = tuple(k + n + r + g for k in KINDS for n in ("", "-") for r in ("", "r") for g in ("", "@"))
#: Weights before any label is seen: negated and reported matches count little; then density and bias.
PRIOR = np.array([{"": 2.0, "-": 0.3}[n] * {"": 1.0, "r": 0.4}[r] * {"": 1.0, "@": 1.2}[g] for _ in KINDS for n in ("", "-") for r in ("", "r") for g in ("", "@")] + [0.3, -3.0])


class Grammar:
    """Matches of one process: an automaton finds terms, the composed transducer marks them clause by clause."""

    def __init__(self, terms: dict[str, tuple[str, float]]):
        self.machine = grammar()
        self.terms = terms
        self.words = ahocorasick.Automaton()
        for t in terms:
            self.words.add_word(t.rstrip("*"), t)
        self.words.make_automaton()

    def hits(self, text: str) -> dict[int, tuple[str, float]]:
        """Start of every word that is a term, with its kind and weight; of several terms the heaviest counts."""
        found: dict[int, tuple[str, float]] = {}
        n = len(text)
        for last, term in self.words.iter(text):
            size = len(term) - (term[-1] == "*")
            start = last + 1 - size
            if start and text[start - 1].isalpha():
                continue
            longer = last + 1 < n and text[last + 1].isalpha()
            if longer != (term[-1] == "*"):
                continue
            kind, weight = self.terms[term]
            if start not in found or found[start][1] < weight:
                found[start] = (kind, weight)
        return found

    def features(self, text: str) -> list[float]:
        """Weights of the matched clauses by kind of match (logarithms of one more), and their density."""
        sums = dict.fromkeys(FEATURES, 0.0)
        text = text.lower()
        found = self.hits(text) if text else {}
        if found:
            marks = [0, *(m.end() for m in _CLAUSE.finditer(text)), len(text) + 1]
            places = sorted(found)
            for c in sorted(set(np.searchsorted(marks, places, side="right").tolist())):
                tokens = [(m.start() + marks[c - 1], m[0]) for m in _TOKEN.finditer(text[marks[c - 1] : marks[c]])]
                quoted, symbols = False, []
                for at, word in tokens:
                    if at in found:
                        symbols.append(found[at][0])
                    elif word in QUOTES:
                        quoted = not quoted
                        symbols.append("r" if quoted else "q")
                    else:
                        symbols.append("g" if word in TARGETS else "n" if word in NEGATIONS else "r" if word in REPORTS else "o")
                for (at, _), put in zip(tokens, self.machine.run(symbols)):
                    if put[0] in KINDS:
                        sums[put] += found[at][1] if at in found else 0.0
        total = sum(sums.values())
        density = math.log1p(1000 * total / (text.count(" ") + 20)) if total else 0.0
        return [*(math.log1p(v) for v in sums.values()), density]


def start_terms() -> dict[str, tuple[str, float]]:
    return {w: ("i", 1.0) for w in INSULTS} | {w: ("t", 0.5) for w in THREATS}


def score(features: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Probability of label 1 from rows of features."""
    return 1 / (1 + np.exp(-np.clip(features @ weights[:-1] + weights[-1], -30, 30)))


def fit(features: np.ndarray, labels: np.ndarray, prior: np.ndarray = PRIOR, pull: float = 1.0) -> np.ndarray:
    """Logistic regression drawn towards ``prior``, by Newton steps."""
    x = np.hstack([features, np.ones((len(features), 1))])
    w = prior.copy()
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (labels - p) - pull * (w - prior)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w)), slope)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


# ------------------------------------------------------------------ learning


def text_terms(text: str) -> set[str]:
    """Words of a text and their stems, the latter marked with a star."""
    out: set[str] = set()
    for w in set(_TOKEN.findall(text.lower())):
        if w.isalpha() and len(w) > 2:
            out.add(w)
            out.update(w[:k] + "*" for k in STEMS if len(w) > k)
    return out


def _decoded(column: list) -> list[str]:
    return [(t or b"").decode() for t in column]


def learn_terms(sample: DataFrame) -> dict[str, tuple[str, float]]:
    """Terms of toxic documents, by coverage; ``sample``: (ident, text, toxic), bounded."""
    rows = text_rows(sample, "ident", "text", ["toxic"])

    def count(columns: list[list]) -> list[list]:
        sums: dict[str, list[int]] = {}
        for text, toxic in zip(_decoded(columns[1]), columns[2]):
            for t in text_terms(text):
                sums.setdefault(t, [0, 0])[toxic] += 1
        return [list(sums), [s[1] for s in sums.values()], [s[0] for s in sums.values()]]

    sizes = dict(sample.groupBy("toxic").count().collect())
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic:
        return {}
    counted = per_batch(rows, count, "term string, toxic bigint, clean bigint").groupBy("term").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")
    )
    chance = toxic * (F.col("clean") + 1) / (clean + 2)
    apart = counted.withColumn("ratio", F.col("toxic") / chance).filter(
        (F.col("toxic") >= LEAST_TOXIC) & (F.col("ratio") >= LEAST_RATIO) & (F.col("toxic") - chance >= LEAST_SIGMAS * F.sqrt(chance))
    )
    found = {r["term"]: (r["toxic"], r["ratio"]) for r in apart.orderBy(F.desc("toxic"), "term").limit(MOST_TERMS).collect()}
    known = sample.sparkSession.sparkContext.broadcast(frozenset(found))

    def list_terms(columns: list[list]) -> list[list]:
        return [[sorted(text_terms(t) & known.value) for t in _decoded(columns[1])]]

    inside = per_batch(rows.filter("toxic = 1"), list_terms, "terms array<string>")
    holders: dict[str, set[int]] = {}
    for i, r in enumerate(inside.collect()):  # at most TRAIN_ROWS documents
        for t in r["terms"]:
            holders.setdefault(t, set()).add(i)
    chosen: dict[str, tuple[str, float]] = {}
    left = {t: set(h) for t, h in holders.items()}
    while left:
        # most newly covered documents; ties: higher ratio, then the longer term
        best = max(left, key=lambda t: (len(left[t]), found[t][1], len(t), t))
        covered = left.pop(best)
        if len(covered) < LEAST_TOXIC:
            break
        chosen[best] = ("i", min(2.0, math.log(found[best][1]) / 4))
        left = {t: h for t, h in ((t, h - covered) for t, h in left.items()) if len(h) >= LEAST_TOXIC}
    return chosen


class Model:
    """Terms and weights, small enough to go along with every task."""

    def __init__(self, terms: dict[str, tuple[str, float]], weights: np.ndarray):
        self.terms = terms
        self.weights = weights


def train(docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model from the labelled rows of the training part (see ``held_out``)."""
    marked = labels.filter(F.col(label).isNotNull() & F.col(ident).isNotNull()).groupBy(ident).agg(F.max(label).cast("int").alias("toxic"))
    few = marked.filter(~held_out(ident)).orderBy(F.xxhash64(ident), ident).limit(TRAIN_ROWS)
    few = few.select(F.col(ident).alias("_labelled"), "toxic")
    # at most TRAIN_ROWS ids: bounded, so it can be broadcast
    sample = docs.select(F.col(ident).alias("ident"), F.col(text).alias("text")).join(F.broadcast(few), F.col("ident") == F.col("_labelled"))
    sample = sample.drop("_labelled").groupBy("text").agg(F.min("ident").alias("ident"), F.max("toxic").alias("toxic"))
    sample = checkpoint(sample.select("ident", "text", "toxic"))
    terms = start_terms() | learn_terms(sample)
    def make(columns: list[list]) -> list[list]:
        g = Grammar(terms)
        return [[g.features(t) for t in _decoded(columns[1])], columns[2]]

    rows = per_batch(text_rows(sample, "ident", "text", ["toxic"]), make, "features array<double>, toxic int").collect()
    if not rows:
        return Model(terms, PRIOR)
    weights = fit(np.array([r["features"] for r in rows]), np.array([float(r["toxic"]) for r in rows]))
    return Model(terms, weights)


def held_out(ident: str):
    """The rows that no label is learned from."""
    return F.coalesce(F.crc32(F.col(ident).cast("string")) % 4 == 2, F.lit(False))


def scores(docs: DataFrame, model: Model, ident: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(ident, score, predicted) of every whole text; no shuffle."""
    terms, weights = model.terms, model.weights

    def make(columns: list[list]) -> list[list]:
        g = _grammar(terms)
        rows = np.array([g.features(t) for t in _decoded(columns[1])]).reshape(-1, len(FEATURES) + 1)
        p = score(rows, weights)
        return [columns[0], p, (p >= threshold).astype(np.int32)]

    kind = docs.schema[ident].dataType.simpleString()
    return per_batch(text_rows(docs, ident, text), make, f"`{ident}` {kind}, score double, predicted int")


_GRAMMARS: dict[int, Grammar] = {}


def _grammar(terms: dict) -> Grammar:
    key = hash(tuple(sorted(terms.items())))
    if key not in _GRAMMARS:
        _GRAMMARS.clear()
        _GRAMMARS[key] = Grammar(terms)
    return _GRAMMARS[key]


def accepted(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are not called toxic, with all their columns and no others."""
    terms, weights = model.terms, model.weights

    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        g = _grammar(terms)
        rows = np.array([g.features(t or "") for t in texts]).reshape(-1, len(FEATURES) + 1)
        return pd.Series(score(rows, weights) < threshold)

    return docs.filter(clean(F.col(text)))
