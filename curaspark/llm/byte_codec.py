"""Byte-level BPE as a tree reduction: halves are encoded, neighbours joined around their border, decoding concatenates.

The tokens of a piece of text form a monoid. Its join takes the tokens of two neighbouring halves, encodes a window around
the border again and keeps what lies outside. A row of tokens is what merging the whole would give exactly when every two
adjacent tokens are: joining their bytes and merging gives the same two tokens again. Within each half and within the window
that holds by construction, so only the two seams of the window are asked; the window grows (its number of tokens doubles)
on the side whose seam fails, up to the whole half. The pattern cuts a text into pieces that never share a token, so above
the pieces the join is plain concatenation. Decoding halves the ids, looks them up at the leaves and concatenates up the tree.

A rank file is fit for this if every token is what merging its own bytes gives; ``load_ranks`` checks that. A piece that is
a token as a whole is that token.

Null or empty texts have no tokens and decode to an empty text. Rows are independent: ties, repeated rows and a null id change
nothing, an empty table gives no rows, and columns other than the id and the text are not read, so their names cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import struct
import sys
import unicodedata
from collections.abc import Callable

import regex
from pyspark.sql import DataFrame

from curaspark.llm.common import Memo, per_batch, text_rows

#: Pieces of at most this many bytes are merged at once; longer ones are halved.
LEAF = 64
#: Ids that are looked up at a leaf of the decoding tree.
LEAF_IDS = 512
#: Longer pieces are not kept in the memo, so that its size is bounded in bytes too.
MEMO_BYTES = 128


def newer_characters(pattern: str) -> str:
    """Letters and numbers that the pattern module knows and the library's own pattern engine does not, as ranges of a set.

    The two may be built with different Unicode versions. Only code points that Python itself leaves unassigned are in
    doubt; a vocabulary that holds them behind a letter and a digit shows whether the library keeps them together.
    """
    import tiktoken

    known = regex.compile(r"[\p{L}\p{N}]").match
    doubt = [c for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cn" and known(chr(c))]
    ranks = {bytes([b]): b for b in range(256)}
    for c in doubt:
        for before in "a1":
            ranks[(before + chr(c)).encode()] = len(ranks)
    ask = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    newer = [c for c in doubt if len(ask("a" + chr(c))) > 1 and len(ask("1" + chr(c))) > 1]
    starts = [c for c, before in zip(newer, [-2, *newer]) if c != before + 1]
    ends = [c for c, after in zip(newer, [*newer[1:], -2]) if c + 1 != after]
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends))


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids left when the adjacent pair whose bytes have the lowest rank (ties: the first) has been merged as long as there is one."""
    n = len(piece)
    parts = [piece[i : i + 1] for i in range(n)]
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i]
        # stale: one of the two parts has been merged since this entry was made
        if not parts[i] or j < 0 or ranks.get(parts[i] + parts[j]) != rank:
            continue
        parts[i] += parts[j]
        parts[j] = b""
        k = after[i] = after[j]
        if k >= 0:
            before[k] = i
            if (r := ranks.get(parts[i] + parts[k])) is not None:
                heapq.heappush(heap, (r, i))
        h = before[i]
        if h >= 0 and (r := ranks.get(parts[h] + parts[i])) is not None:
            heapq.heappush(heap, (r, h))
    return [ranks[p] for p in parts if p]


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks; every byte must be a token, and every token what merging its own bytes gives."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("every byte must be a token")
    if any(merge(token, ranks) != [rank] for token, rank in ranks.items()):
        raise ValueError("merging the bytes of every token must give that token")
    return ranks


class Codec:
    """Encodes and decodes whole texts; pieces and seams seen before come from bounded memos."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, newer: str = "", leaf: int = LEAF):
        self.ranks, self.leaf = ranks, leaf
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.find = regex.compile(pattern).findall
        self.newer = re.compile(f"[{newer}]").search if newer else None
        if newer:  # the same pattern without the newer characters; slow, so only texts that hold one use it
            exact = re.sub(r"\\p\{([LN])\}", lambda m: rf"[\p{{{m[1]}}}--[{newer}]]", pattern)
            self.find_exact = regex.compile(exact, regex.V1).findall
        self.packed = Memo(lambda piece: self._pack(self.encode_piece(piece.encode())))
        self.seams = Memo(lambda pair: merge(self.tokens[pair[0]] + self.tokens[pair[1]], ranks) == [*pair])

    @staticmethod
    def _pack(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    # -- encoding

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self._reduce(piece)

    def _reduce(self, piece: bytes) -> list[int]:
        if len(piece) <= self.leaf:
            return merge(piece, self.ranks)
        half = 1 << (len(piece) - 1).bit_length() - 1  # a power of two: runs of one character then end at a token of their own
        return self.join(self._reduce(piece[:half]), self._reduce(piece[half:]))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The tokens of two neighbours' bytes, from the tokens of each."""
        if not left or not right:
            return left + right
        back, forth = 1, 1
        while True:
            a, b = len(left) - back, forth
            middle = merge(b"".join(map(self.tokens.__getitem__, left[a:] + right[:b])), self.ranks)
            firm_left = a == 0 or self.seams[left[a - 1], middle[0]]
            firm_right = b == len(right) or self.seams[middle[-1], right[b]]
            if firm_left and firm_right:
                return left[:a] + middle + right[b:]
            if not firm_left:
                back = min(2 * back, len(left))
            if not firm_right:
                forth = min(2 * forth, len(right))

    def pieces(self, text: str) -> list[str]:
        exact = self.newer is not None and not text.isascii() and self.newer(text)
        return (self.find_exact if exact else self.find)(text)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        packed = self.packed
        return b"".join(
            [packed[p] if len(p) <= MEMO_BYTES else self._pack(self.encode_piece(p.encode())) for p in self.pieces(text)]
        )

    # -- decoding

    def decode(self, packed: bytes) -> bytes:
        """Bytes of the ids; an unknown id is an error."""
        return self._concatenate(memoryview(packed).cast("I") if sys.byteorder == "little" else struct.unpack(f"<{len(packed) // 4}I", packed))

    def _concatenate(self, ids) -> bytes:
        if len(ids) <= LEAF_IDS:
            return b"".join(map(self.tokens.__getitem__, ids))
        half = len(ids) // 2
        return self._concatenate(ids[:half]) + self._concatenate(ids[half:])


# ------------------------------------------------------------------ tables

_LAST: list = [None, None]


def _codec_of(docs: DataFrame, path: str, pattern: str) -> Callable[[], Codec]:
    """The codec of an executor's process, made once from what the driver read (a fixed few hundred kilobytes)."""
    shared = docs.sparkSession.sparkContext.broadcast((load_ranks(path), pattern, newer_characters(pattern)))

    def get() -> Codec:
        made_of = shared.value
        if _LAST[0] is not made_of:
            _LAST[:] = made_of, Codec(*made_of)
        return _LAST[1]

    return get


def encoded(docs: DataFrame, path: str, pattern: str, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(ident, ids): the ids of every whole text as an array. No shuffle."""
    codec = _codec_of(docs, path, pattern)

    def make(columns: list[list]) -> list[list]:
        encode = codec().encode
        return [columns[0], [struct.unpack(f"<{len(p) // 4}I", p) for p in (encode((t or b"").decode()) for t in columns[1])]]

    kind = docs.schema[ident].dataType.simpleString()
    return per_batch(text_rows(docs, ident, text), make, f"`{ident}` {kind}, ids array<int>")


def decoded(ids: DataFrame, path: str, pattern: str, ident: str = "doc_id") -> DataFrame:
    """(ident, text) back from (ident, ids); bytes that are not UTF-8 (ids that no text gives) become the replacement character."""
    codec = _codec_of(ids, path, pattern)

    def make(columns: list[list]) -> list[list]:
        decode = codec().decode
        return [columns[0], [decode(Codec._pack(row or [])).decode("utf-8", "replace") for row in columns[1]]]

    kind = ids.schema[ident].dataType.simpleString()
    return per_batch(ids.select(ident, "ids"), make, f"`{ident}` {kind}, text string")


def digests(docs: DataFrame, path: str, pattern: str, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(ident, n_tokens, ids_sha256, decoded_sha256) of every whole text, the last from decoding the ids again."""
    codec = _codec_of(docs, path, pattern)

    def make(columns: list[list]) -> list[list]:
        both = codec()
        ids, texts = columns
        packed = [both.encode((t or b"").decode()) for t in texts]
        back = [both.decode(p) for p in packed]
        return [
            ids, [len(p) // 4 for p in packed], [hashlib.sha256(p).hexdigest() for p in packed], [hashlib.sha256(b).hexdigest() for b in back],
        ]

    kind = docs.schema[ident].dataType.simpleString()
    return per_batch(text_rows(docs, ident, text), make, f"`{ident}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
