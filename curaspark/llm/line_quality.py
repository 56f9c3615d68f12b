"""Quality rules that clean lines first and then judge what is left of a document.

Every line with a word is tried on its own: shouting, symbol noise, navigation (separators between short items),
boilerplate (fixed phrases, lines said before in the document), stuttering words, and prose without a closing mark.
Lines that fail are removed; a document that loses too large a share of its words is rejected.

Null and empty texts have no words and are rejected by the base rules. Lines without a word are not judged. Rows are
independent, whatever their order.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame

from curaspark.llm.common import per_batch, text_rows, window_hashes, word_hashes

#: A document is rejected when more than this share of its words stands in removed lines.
MOST_LOST = 0.5
#: Base rules: the fewest words, and the largest share of words in repeated three-word windows, in hundredths.
MIN_WORDS, MOST_REPEATED = 50, 50
#: A line of so many words without a closing mark is no prose; shorter ones may be headings.
PROSE = 12
#: Marks that close a line, separators of navigation, symbols, white space, boilerplate phrases.
CLOSING = tuple(".!?…:;\"'”’»)]。！？")
SEPARATORS = frozenset(("|", "·", "•", "»", "›", ">", "/", "—"))
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
BOILERPLATE = re.compile(
    r"javascript|cookies?\b|lorem ipsum|all rights reserved|terms of (?:use|service)|privacy policy|copyright|©|sign in|log ?in|"
    r"subscribe|newsletter|click here|read more|licen[cs]ed under", re.I
)


def line_fails(line: str, words: list[bytes], seen: bool) -> str | None:
    """Name of the first rule that a line fails, or None."""
    n = len(words)
    symbols = sum(map(line.count, SYMBOLS))
    letters = line.upper()
    if seen and n >= 3:
        return "repeated"
    if n >= 3 and letters == line and line.lower() != line:
        return "shouting"
    separators = sum(w.decode() in SEPARATORS for w in words)
    if separators >= 2 and 3 * separators >= n - separators:
        return "navigation"
    if 3 * symbols > n and symbols >= 3:
        return "symbols"
    if n <= 30 and BOILERPLATE.search(line):
        return "boilerplate"
    if n >= 6 and 3 * len(set(words)) < n:
        return "stutter"
    if n >= PROSE and not line.rstrip().endswith(CLOSING):
        return "unclosed"
    return None


def judge(text: bytes | None) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, removed_words, cleaned text)."""
    text = text or b""
    whole = text.decode()
    words = text.split()
    n = len(words)
    word_chars = len(whole) - sum(map(whole.count, SPACES))
    symbols = sum(map(whole.count, SYMBOLS))
    seen: set[str] = set()
    repeated = removed = 0
    kept_lines = []
    for line in whole.split("\n"):
        in_line = line.encode().split()
        if not in_line:
            kept_lines.append(line)
            continue
        again = line in seen
        repeated += again
        seen.add(line)
        if line_fails(line, in_line, again):
            removed += len(in_line)
        else:
            kept_lines.append(line)
    in_repeats = 0
    if n >= 3:
        _, which, counts = np.unique(window_hashes(word_hashes(words), 3), return_inverse=True, return_counts=True)
        twice = counts[which] > 1
        covered = np.zeros(n, bool)
        for j in range(3):
            covered[j : n - 2 + j] |= twice
        in_repeats = int(covered.sum())
    failed = n < MIN_WORDS or 100 * in_repeats > MOST_REPEATED * n
    return n, word_chars, symbols, repeated, in_repeats, failed, not failed and removed <= MOST_LOST * n, removed, "\n".join(kept_lines)


_FIELDS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, removed_words bigint"


def verdicts(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(ident, counts, base_failed, kept, removed_words) of every whole text; no shuffle."""

    def make(columns: list[list]) -> list[list]:
        rows = [judge(t)[:8] for t in columns[1]]
        return [columns[0], *([list(c) for c in zip(*rows)] if rows else [[]] * 8)]

    kind = docs.schema[ident].dataType.simpleString()
    return per_batch(text_rows(docs, ident, text), make, f"`{ident}` {kind}, {_FIELDS}")


def cleaned(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(ident, text): the kept documents without the lines that failed."""

    def make(columns: list[list]) -> list[list]:
        rows = [(i, judge(t)) for i, t in zip(*columns)]
        rows = [(i, v[8]) for i, v in rows if v[6]]
        return [[i for i, _ in rows], [t for _, t in rows]]

    kind = docs.schema[ident].dataType.simpleString()
    return per_batch(text_rows(docs, ident, text), make, f"`{ident}` {kind}, text string")
