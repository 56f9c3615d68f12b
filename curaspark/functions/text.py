"""Prompt-text expressions: term lists, similarity, truncation and metadata text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(text) -> Column:
    """Remove leading and trailing white space of any kind."""
    return F.regexp_replace(_col(text), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def ensure_str(text) -> Column:
    """Null becomes ''."""
    return F.coalesce(_col(text).cast("string"), F.lit(""))


def search_terms(text) -> Column:
    """Comma-separated, trimmed, non-empty terms."""
    parts = F.transform(F.split(ensure_str(text), ","), strip)
    return F.filter(parts, lambda t: t != "")


def split_escaped(text, delimiter: str = ",") -> Column:
    """Split at a delimiter that is not preceded by a backslash; escaped delimiters are kept plain.

    A trailing empty part is dropped.
    """
    parts = F.split(_col(text), rf"(?<!\\)\Q{delimiter}\E")
    plain = F.transform(parts, lambda p: F.replace(p, F.lit("\\" + delimiter), F.lit(delimiter)))
    last_empty = F.element_at(plain, -1) == ""
    return F.when(last_empty, F.slice(plain, F.lit(1), F.size(plain) - 1)).otherwise(plain)


def join_escaped(parts, delimiter: str = ",") -> Column:
    """Inverse of :func:`split_escaped`."""
    safe = F.transform(_col(parts), lambda p: F.replace(p, F.lit(delimiter), F.lit("\\" + delimiter)))
    return F.array_join(safe, delimiter)


# ------------------------------------------------------------------ similarity

# Fixed values of the text score.
CONTAINED = 0.9
ELEMENT_BOOST = 1.3
ELEMENT_CAP = 0.95
FUZZY_CAP = 0.7
POSITIVE_WEIGHT = 0.7
NEGATIVE_WEIGHT = 0.3


def elements(low) -> Column:
    """Distinct non-empty pieces of a text cut at commas, and again cut at line ends."""
    t = _col(low)
    pieces = F.concat(F.split(t, ","), F.split(t, "\n"), F.split(t, "\r\n"))
    return F.array_distinct(F.filter(F.transform(pieces, strip), lambda e: e != ""))


def words(low) -> Column:
    return F.array_distinct(F.filter(F.split(_col(low), r"[\s\p{Z}]+"), lambda w: w != ""))


def prepare(text) -> Column:
    """Everything the text score needs from one text, so a join computes it once per row."""
    raw = ensure_str(text)
    low = strip(F.lower(raw))
    return F.struct((raw == "").alias("empty"), low.alias("low"), elements(low).alias("elems"), words(low).alias("words"))


def fuzzy_word_similarity(a, b) -> Column:
    """Word-set score: exact words, 0.8 per containing pair, 0.6 per pair within edit distance 2,
    over the number of distinct words. Null arguments cost nothing and score 0."""
    from curaspark.functions.fuzzy import fuzzy_words

    return fuzzy_words(_col(a), _col(b))


def prepared_similarity(p, q, fuzzy: bool = True) -> Column:
    """Text score of two prepared texts.

    Empty 0, equal 1, containment 0.9, else the Jaccard index of the elements (boosted when two or
    more are shared), else the fuzzy word score, capped.
    """
    a, b = _col(p), _col(q)
    first = (
        F.when(a["empty"] | b["empty"], F.lit(0.0))
        .when(a["low"] == b["low"], F.lit(1.0))
        .when(F.contains(a["low"], b["low"]) | F.contains(b["low"], a["low"]), F.lit(CONTAINED))
        .otherwise(element_score(a["elems"], b["elems"]))
    )
    if not fuzzy:
        return F.coalesce(first, F.lit(0.0))
    return with_fuzzy(first, a["words"], b["words"])


def element_score(a, b) -> Column:
    """Jaccard index of the elements, boosted when two or more are shared; null without a shared one."""
    shared = F.size(F.array_intersect(_col(a), _col(b)))
    ratio = shared / F.size(F.array_union(_col(a), _col(b)))
    return F.when(shared >= 2, F.least(F.lit(ELEMENT_CAP), ratio * ELEMENT_BOOST)).when(shared > 0, ratio)


def with_fuzzy(first: Column, a, b) -> Column:
    """The score so far, or where it is null the capped word score of two word lists."""
    # only texts undecided so far are handed to the word score
    left = fuzzy_word_similarity(F.when(first.isNull(), _col(a)), F.when(first.isNull(), _col(b)))
    return F.coalesce(first, F.least(F.lit(FUZZY_CAP), left))


def text_similarity(a, b, fuzzy: bool = True) -> Column:
    return prepared_similarity(prepare(a), prepare(b), fuzzy)


# ------------------------------------------------------------------ prompt rules


def contains_any(text, terms: Sequence[str]) -> Column:
    """Case-insensitive: the text contains any of the terms."""
    low = F.lower(_col(text))
    test = F.lit(False)
    for term in terms:
        test = test | F.contains(low, F.lit(term.lower()))
    return test


def prompt_match(pos, neg, positives: Sequence[str] = (), negatives: Sequence[str] = ()) -> Column:
    """Any positive term in the positive text and any negative term in the negative text.

    A side without configured terms passes; a missing positive text never matches.
    """
    one = contains_any(ensure_str(pos), positives) if positives else F.lit(True)
    two = contains_any(ensure_str(neg), negatives) if negatives else F.lit(True)
    return _col(pos).isNotNull() & one & two


def prompt_condition(pos, terms: Sequence[str]) -> Column:
    """Any term (or blacklist entry) in the positive text; no terms or no text never match."""
    return F.coalesce(contains_any(pos, terms), F.lit(False)) if terms else F.lit(False)


def truncate_prompt(text, size: int = 2000) -> Column:
    t = _col(text)
    return F.when(F.length(t) > size, F.concat(F.left(t, F.lit(size)), F.lit("..."))).otherwise(t)


def strip_emphasis(text) -> Column:
    """Prompt text after its first BREAK, without emphasis brackets, ':1.2' weights and <tags>."""
    t = _col(text)
    at = F.locate("BREAK", t)
    t = F.when(at > 0, F.substring(t, at + F.lit(6), F.length(t))).otherwise(t)
    t = F.translate(t, "()[]", "")
    t = F.regexp_replace(t, r":[0-9]*\.[0-9]+", "")
    return F.regexp_replace(t, r"<[^>]*>", "")


def prompt_cascade(*candidates) -> Column:
    """First candidate text that is not blank."""
    return F.coalesce(*[F.when(strip(c) != "", _col(c)) for c in candidates])


# ------------------------------------------------------------------ small parsers


def parse_size(text) -> Column:
    """struct<w,h> of 'WxH', 'W,H' or 'W H', null when none fits."""
    t = _col(text)
    forms = [r"(\d+)\s*[xX]\s*(\d+)", r"(\d+)\s*,\s*(\d+)", r"(\d+)\s+(\d+)"]

    def form(pattern: str) -> Column:
        return F.when(
            t.rlike(pattern),
            F.struct(
                F.regexp_extract(t, pattern, 1).cast("bigint").alias("w"),
                F.regexp_extract(t, pattern, 2).cast("bigint").alias("h"),
            ),
        )

    return F.coalesce(*[form(p) for p in forms])


def size_similarity(w1, h1, w2, h2, tolerance: int = 0) -> Column:
    """1 for equal sizes, the mean closeness inside the tolerance, else 0."""
    dw, dh = F.abs(_col(w1) - _col(w2)), F.abs(_col(h1) - _col(h2))
    inside = (dw <= tolerance) & (dh <= tolerance)
    if tolerance == 0:
        return F.when(inside, F.lit(1.0)).otherwise(F.lit(0.0))
    score = ((1 - dw / F.lit(tolerance)) + (1 - dh / F.lit(tolerance))) / 2
    return F.when(inside, score).otherwise(F.lit(0.0))


def reduced_ratio(w, h) -> Column:
    """struct<rw,rh>: the aspect ratio in lowest terms (Euclid's steps folded over a fixed count)."""
    a, b = _col(w).cast("bigint"), _col(h).cast("bigint")
    start = F.struct(a.alias("x"), b.alias("y"))
    # 92 steps are enough for every pair of 64-bit integers
    gcd = F.aggregate(
        F.sequence(F.lit(1), F.lit(92)),
        start,
        lambda s, _: F.when(s["y"] == 0, s).otherwise(
            F.struct(s["y"].alias("x"), (s["x"] % s["y"]).alias("y"))
        ),
        lambda s: s["x"],
    )
    parts = F.transform(F.array(gcd), lambda g: F.struct((a / g).cast("bigint").alias("rw"), (b / g).cast("bigint").alias("rh")))
    return F.element_at(parts, 1)


def rotation_degrees(label) -> Column:
    """Leading whole number of a label as degrees below 360; null unless a multiple of 90."""
    value = F.nullif(F.regexp_extract(strip(label), r"^([0-9]+)", 1), F.lit("")).cast("bigint")
    return F.when(value % 90 == 0, (value % 360).cast("int"))


def frame_cap(total, fps, duration, max_seconds: float, size_mb, max_mb: float) -> Column:
    """Frames to consider: a duration limit that shrinks with file size but not below 30 seconds."""
    n, rate, size = _col(total), _col(fps), _col(size_mb)
    if max_seconds <= 0:
        return n
    seconds = F.lit(float(max_seconds))
    if max_mb > 0:
        shrunk = F.greatest(F.lit(30.0), seconds * max_mb / size)
        seconds = F.when(size > max_mb, shrunk).otherwise(seconds)
    known = F.coalesce(_col(duration), F.when(rate > 0, n / rate))
    capped = F.greatest(F.lit(1), F.floor(rate * seconds).cast("bigint"))
    return F.when((n <= 0) | known.isNull() | (known <= seconds) | (rate <= 0), n).otherwise(capped)
