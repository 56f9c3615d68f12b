"""Path, file-name and stem expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ------------------------------------------------------------------ path parts


def basename(path) -> Column:
    return F.substring_index(_col(path), "/", -1)


def ext(path) -> Column:
    """Extension with its dot; leading dots of the name do not start an extension."""
    return F.regexp_extract(basename(path), r"(?s)^\.*[^.].*?(\.[^.]*)$", 1)


def stem(path) -> Column:
    """Name without its extension."""
    return F.regexp_replace(basename(path), r"(?s)^(\.*[^.].*)\.[^.]*$", "$1")


def dirname(path) -> Column:
    """Everything before the last slash, '' for a bare name."""
    return F.regexp_extract(_col(path), r"(?s)^(.*)/[^/]*$", 1)


def relative_tail(path, levels: int = 2) -> Column:
    """Last ``levels`` directory names of the path, lower-cased."""
    parts = F.filter(F.split(F.lower(dirname(path)), "/"), lambda p: p != "")
    return F.slice(parts, F.greatest(F.size(parts) - levels + 1, F.lit(1)), levels)


# Extensions by media type.
VIDEO_EXTENSIONS = (".mp4", ".mkv", ".avi", ".wmv", ".mov", ".flv", ".webm", ".m4v", ".ogv", ".mpeg", ".mpg")
AUDIO_EXTENSIONS = (
    ".mp3", ".flac", ".ogg", ".opus", ".wav", ".m4a", ".m4b", ".aac", ".wma", ".weba", ".aiff", ".aif", ".au", ".ape", ".wv",
)
MEDIA_FLAGS = ("audio", "video", "gif", "pdf", "svg", "html")


def media_type(path, enabled: Sequence[str] = MEDIA_FLAGS) -> Column:
    """Media type by suffix; a known but disabled type is 'unconfigured', anything else 'image'."""
    low = F.lower(_col(path))

    def any_suffix(suffixes: Sequence[str]) -> Column:
        test = F.lit(False)
        for s in suffixes:
            test = test | F.endswith(low, F.lit(s))
        return test

    def kind(name: str) -> Column:
        return F.lit(name if name in enabled else "unconfigured")

    return (
        F.when(_col(path).isNull() | (_col(path) == ""), "unconfigured")
        .when(any_suffix(AUDIO_EXTENSIONS), kind("audio"))
        .when(any_suffix(VIDEO_EXTENSIONS), kind("video"))
        .when(any_suffix((".gif",)), kind("gif"))
        .when(any_suffix((".pdf",)), kind("pdf"))
        .when(any_suffix((".svg",)), kind("svg"))
        .when(any_suffix((".html", ".htm")), kind("html"))
        .otherwise("image")
    )


# ------------------------------------------------------------------ stems

_D = r"[_\s\p{Z}\-.]"
_W = r"[^_\s\p{Z}\-.]"
_TWO_PARTS = rf"{_W}*+{_D}++{_W}{{5,}}+"
_THREE_PARTS = rf"{_TWO_PARTS}{_D}++{_W}{{5,}}+"
# A first part of 30 characters stands alone; one of 3 does before a second part of up to 4 characters;
# two parts are enough from 10 characters on.
_LONG_FIRST = rf"{_W}{{30,}}+(?={_D})"
_BEFORE_SHORT = rf"{_W}{{3,}}+(?={_D}++{_W}{{0,4}}+(?:{_D}|$))"
_ENOUGH = 10


def base_stem_of(name) -> Column:
    """Base stem of a name without extension (see :func:`base_stem`)."""
    s = _col(name)

    def head(pattern: str) -> Column:
        return F.regexp_extract(s, rf"(?s)^({pattern})", 1)

    long_first, before_short, two, three = map(head, (_LONG_FIRST, _BEFORE_SHORT, _TWO_PARTS, _THREE_PARTS))
    # results other than a long first part and two long parts must hold a letter or digit
    short = F.when(before_short != "", before_short).when(three != "", three).otherwise(two)
    whole = F.when(short.rlike(r"[\p{L}\p{N}]"), short).otherwise(s)
    return (
        F.when(long_first != "", long_first)
        .when(before_short != "", whole)
        .when(F.length(two) >= _ENOUGH, two)
        .otherwise(whole)
    )


def base_stem(path) -> Column:
    """Stem shared by an original and its variants.

    The name is cut at runs of ``_``, space, ``-`` and ``.``. A first part of 30 or more characters
    is the stem; a second part of up to 4 characters leaves the first part (when it has at least 3
    characters); otherwise parts of more than 4 characters are appended until 10 characters are
    reached. As a second part has at least 5 characters, at most one further part is ever needed.
    """
    return base_stem_of(stem(path))


def variant_tail(path) -> Column:
    """What follows the base stem in the name, '' when nothing does."""
    s, b = stem(path), base_stem(path)
    return F.when(F.length(b) < F.length(s), F.substring(s, F.length(b) + 1, F.length(s))).otherwise("")


def char_category(c) -> Column:
    ch = _col(c)
    return F.when(ch.rlike(r"^\p{L}"), "alpha").when(ch.rlike(r"^\p{Nd}"), "digit").otherwise("other")


def boundary_ok(full, base) -> Column:
    """Whether ``full`` continues ``base`` at a stem boundary (end, separator, or class change)."""
    f, b = _col(full), _col(base)
    nxt = F.substring(f, F.length(b) + 1, F.lit(1))
    last = F.when(F.length(b) > 0, char_category(F.right(b, F.lit(1)))).otherwise("other")
    return F.startswith(f, b) & (
        (F.length(f) == F.length(b)) | nxt.isin("_", " ", "-", ".") | (last != char_category(nxt))
    )


def suffix_is_numeric(suffix) -> Column:
    return F.regexp_replace(_col(suffix), r"^[_ ]+", "").rlike(r"^\p{Nd}+$")


def valid_suffix(suffix) -> Column:
    """1–8 ASCII letters or digits, not digits only."""
    s = _col(suffix)
    return s.rlike(r"^[A-Za-z0-9]{1,8}$") & ~suffix_is_numeric(s)


def suffix_matches(name_stem, suffixes: Sequence[str]) -> Column:
    """Whether a stem ends with a (right-truncated) configured suffix after a non-alphanumeric.

    Leading separators of the configured suffix are dropped, case is ignored and a trailing number
    of the stem is optional.
    """
    cores = [c for c in (x.lower().lstrip("_ ") for x in suffixes) if c]
    if not cores:
        return F.lit(False)
    tails = sorted({core[:k] for core in cores for k in range(1, len(core) + 1)}, key=len, reverse=True)
    any_tail = "|".join(re.sub(r"([^\w\s])", r"\\\1", t) for t in tails)
    number = r"(?:[_ ]+\p{Nd}+|(?<!\p{Nd})\p{Nd}+)?"
    return F.lower(_col(name_stem)).rlike(rf"(?s)(?:^|[^\p{{L}}\p{{N}}])(?:{any_tail}){number}$")


def known_suffix(name_stem, suffixes: Sequence[str]) -> Column:
    """A configured suffix, or a tail after the base stem that is only digits and separators."""
    s = _col(name_stem)
    base = base_stem_of(stem(s))
    tail = F.substring(s, F.length(base) + 1, F.length(s))
    numeric_tail = (F.length(base) > 0) & (F.length(base) < F.length(s)) & suffix_is_numeric(tail)
    return suffix_matches(s, suffixes) | numeric_tail


def strip_variant(name_stem, strict: bool = False) -> Column:
    """Stem without its ``_variant`` tail (letters only when strict); null without such a tail."""
    chars = "A-Za-z" if strict else "A-Za-z0-9"
    found = F.regexp_extract(_col(name_stem), rf"^(.+)_[{chars}]{{1,8}}$", 1)
    return F.nullif(found, F.lit(""))


# ------------------------------------------------------------------ order keys


def _number_key(digits: Column) -> Column:
    plain = F.regexp_replace(digits, "^0+(?=[0-9])", "")
    return F.concat(F.lit("\x01"), F.lpad(F.length(plain).cast("string"), 6, "0"), plain)


def natural_key(text) -> Column:
    """Sort key that orders digit runs by value.

    A digit run becomes its length and its digits behind a mark that sorts before any text, so
    longer numbers are larger and a number sorts before any further letter.
    """
    parts = F.regexp_extract_all(F.lower(_col(text)), F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(
        F.transform(
            parts,
            lambda p: F.when(p.rlike("^[0-9]"), _number_key(p)).otherwise(p),
        ),
        "",
    )


def truncate_middle(text, size: int) -> Column:
    """Keep both ends of a long text with '...' between them."""
    s = _col(text)
    left = int(size / 2 - 2)
    right = -int(-size / 2 - 1)
    return F.when(F.length(s) <= size, s).otherwise(
        F.concat(F.left(s, F.lit(left)), F.lit("..."), F.right(s, F.lit(right)))
    )


# ------------------------------------------------------------------ filters on paths


def split_filter(text: str | None) -> tuple[list[str], list[str]]:
    """';'-separated terms of a path filter as (included, excluded); '!' marks exclusion."""
    terms = [t.strip() for t in (text or "").split(";") if t.strip()]
    return [t for t in terms if not t.startswith("!")], [t[1:] for t in terms if t.startswith("!") and len(t) > 1]


def path_filter(path, text: str | None) -> Column:
    """Plain substring filter: any included term and no excluded term."""
    p = _col(path)
    included, excluded = split_filter(text)
    keep = F.lit(not included)
    for term in included:
        keep = keep | F.contains(p, F.lit(term))
    for term in excluded:
        keep = keep & ~F.contains(p, F.lit(term))
    return keep


def glob_regex(pattern: str) -> str:
    """Anchored regular expression of a shell pattern with *, ? and [...]."""
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        close = pattern.find("]", i + 2) if ch == "[" else -1
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif close > 0:
            body = pattern[i + 1 : close].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body[0] == "!" else body) + "]")
            i = close
        elif ch.isalnum() or ch in "_/ ":
            out.append(ch)
        else:
            out.append("\\" + ch)
        i += 1
    return "(?s)^" + "".join(out) + "$"


def scan_filter(path, text: str | None, mode: str = "glob") -> Column:
    """Listing filter. 'glob': included globs on the relative path (open-ended), excluded globs on
    the basename. 'list': regular expressions searched in the whole path."""
    p = _col(path)
    included, excluded = split_filter(text)
    keep = F.lit(not included)
    for term in included:
        if mode == "list":
            keep = keep | p.rlike(term)
        else:
            pattern = term if "*" in term else term + "*"
            keep = keep | basename(p).rlike(glob_regex(pattern))
    for term in excluded:
        keep = keep & ~(p.rlike(term) if mode == "list" else basename(p).rlike(glob_regex(term)))
    return keep


def filename_contains(path, patterns: Sequence[str], case_sensitive: bool = False) -> Column:
    """Basename contains any non-empty pattern; no patterns never match."""
    name = basename(path) if case_sensitive else F.lower(basename(path))
    test = F.lit(False)
    for pattern in patterns:
        text = pattern if case_sensitive else pattern.lower()
        if text:
            test = test | F.contains(name, F.lit(text))
    return test
