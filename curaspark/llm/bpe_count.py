"""Token counts of a byte-level BPE vocabulary, by merging with a heap and a linked list.

Every pre-token starts as one symbol per byte. A heap holds the adjacent pairs that the vocabulary can
merge, by rank and place; the lowest is popped again and again, and neighbours are found through a linked
list. The count of a pre-token is its initial symbols minus the merges made: no identifiers are formed.

Null or empty texts have no tokens. Special strings inside a text count as one token each, as in the
library's default. Rows are independent: ties, repeated rows and a null id change nothing.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
import unicodedata

import regex
from pyspark.sql import DataFrame

from curaspark.llm.common import Memo, per_batch, text_rows

#: Fixed value: the pre-token pattern of byte-level BPE; L and N stand for the sets of letters and numbers.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[L]+| ?[N]+| ?[^\sLN]+|\s+(?!\S)|\s+"


def newer_letters() -> str:
    """Letters and numbers that the pattern module knows and the tokenizer library does not, as ranges of a set.

    The two were built with different Unicode versions. Code points that Python itself leaves unassigned are
    the only ones in doubt; the library's own pre-tokenizer tells how it sees each of them.
    """
    from tokenizers.pre_tokenizers import ByteLevel

    ask = ByteLevel(add_prefix_space=False).pre_tokenize_str
    known = regex.compile(r"[\p{L}\p{N}]").match
    doubt = (chr(c) for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cn")
    newer = [ord(c) for c in doubt if known(c) and len(ask(f"a{c}1")) == 3]
    starts = [c for c, before in zip(newer, [-2, *newer]) if c != before + 1]
    ends = [c for c, after in zip(newer, [*newer[1:], -2]) if c + 1 != after]
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends))


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where it is visible, else from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in visible else next(spare)) for b in range(256)]


def load_vocabulary(path: str) -> dict:
    """Merges (in rank order) and special strings of a tokenizer file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    step = spec.get("pre_tokenizer") or {}
    if spec["model"]["type"] != "BPE" or step.get("type") != "ByteLevel" or step.get("add_prefix_space") or spec.get("normalizer"):
        raise ValueError("only byte-level BPE without normalizer or prefix space is counted here")
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    special = [t["content"] for t in spec.get("added_tokens", [])]
    if any(t[k] for t in spec.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word")):
        raise ValueError("special strings that take in white space or need word bounds are not counted here")
    return {"merges": merges, "special": sorted(special, key=len, reverse=True), "newer": newer_letters()}


def merged_length(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Number of symbols left when no adjacent pair has a rank."""
    n = len(symbols)
    if n < 2:
        return n
    before = list(range(-1, n - 1))
    after = [*range(1, n), -1]
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    heapq.heapify(heap)
    merges = 0
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i]
        # stale: one of the two symbols has been merged since this entry was made
        if symbols[i] == "" or j < 0 or ranks.get((symbols[i], symbols[j])) != rank:
            continue
        symbols[i] += symbols[j]
        symbols[j] = ""
        merges += 1
        k = after[i] = after[j]
        if k >= 0:
            before[k] = i
            if (r := ranks.get((symbols[i], symbols[k]))) is not None:
                heapq.heappush(heap, (r, i))
        h = before[i]
        if h >= 0 and (r := ranks.get((symbols[h], symbols[i]))) is not None:
            heapq.heappush(heap, (r, h))
    return n - merges


class Counter:
    """Counts whole texts; pre-tokens seen before come from a bounded memo."""

    def __init__(self, vocabulary: dict):
        ranks = {pair: r for r, pair in enumerate(vocabulary["merges"])}
        letters = dict(enumerate(byte_letters()))
        plain = PRETOKEN.replace("[L]", r"\p{L}").replace("[N]", r"\p{N}").replace(r"[^\sLN]", r"[^\s\p{L}\p{N}]")
        self.find = regex.compile(plain).findall
        new = vocabulary["newer"]
        self.newer = re.compile(f"[{new}]").search if new else None
        if new:  # the same sets less the newer letters; slow, so only texts that hold one use it
            letter, number = (rf"[\p{{{kind}}}--[{new}]]" for kind in "LN")
            exact = PRETOKEN.replace("[L]", letter).replace("[N]", number).replace(r"[^\sLN]", rf"[^\s{letter}{number}]")
            self.find_exact = regex.compile(exact, regex.V1).findall
        special = vocabulary["special"]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.memo = Memo(lambda piece: merged_length([*piece.encode().decode("latin-1").translate(letters)], ranks), 600_000)

    def count(self, text: str) -> int:
        if self.special is None:
            parts, total = [text], 0
        else:
            parts = self.special.split(text)
            total = len(parts) - 1
        exact = self.newer is not None and not text.isascii() and self.newer(text)
        find = self.find_exact if exact else self.find
        for part in parts:
            total += sum(map(self.memo.__getitem__, find(part)))
        return total


_COUNTERS: dict[int, Counter] = {}


def token_counts(docs: DataFrame, path: str, limit: int = 1024, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(ident, n_bytes, n_tokens, over_limit) of every whole text.

    ``path`` is the tokenizer file, read once on the driver; its merges (a fixed few hundred kilobytes)
    go to the executors as a broadcast variable. No shuffle.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(load_vocabulary(path))

    def make(columns: list[list]) -> list[list]:
        key = vocabulary.id if hasattr(vocabulary, "id") else id(vocabulary)
        if key not in _COUNTERS:
            _COUNTERS.clear()
            _COUNTERS[key] = Counter(vocabulary.value)
        count = _COUNTERS[key].count
        ids, texts = columns
        sizes = [len(t or b"") for t in texts]
        tokens = [count((t or b"").decode()) for t in texts]
        return [ids, sizes, tokens, [n > limit for n in tokens]]

    kind = docs.schema[ident].dataType.simpleString()
    return per_batch(text_rows(docs, ident, text), make, f"`{ident}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
