"""Exact encoding and decoding with a merge-type SentencePiece vocabulary, by backtracking.

A text is normalised as the model asks (a leading mark, blanks as marks) and cut where no piece can reach
across. For each part an Aho-Corasick automaton lists the pieces that start at every place. The encoder takes
the longest piece, keeps it if it is compatible with the piece before it - merging the two spellings again
must give exactly those two pieces - and otherwise tries the next shorter one. A place from which no piece
leads on is marked in a bitfield and never tried again. The one sequence whose neighbours are all compatible
is what merging by score gives.

Null and empty texts give the end id alone and decode to an empty text. Rows are independent: ties, repeated
rows and null ids change nothing.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
from pyspark.sql import DataFrame

from curaspark.llm.common import Memo, per_batch, text_rows

#: Fixed value: the letter that stands for a blank inside pieces.
MARK = "▁"


def load_model(path: str) -> dict:
    """Pieces, scores and kinds of a model file, as plain lists that can be sent to executors."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kinds = []
    for i in range(model.get_piece_size()):
        if model.is_byte(i):
            kinds.append("byte")
        elif model.is_control(i):
            kinds.append("control")
        elif model.is_unknown(i):
            kinds.append("unknown")
        elif model.is_unused(i):
            raise ValueError("pieces marked unused are not supported")
        else:
            kinds.append("normal")
    if kinds.count("byte") != 256:
        raise ValueError("only models with byte fallback are supported")
    n = len(kinds)
    return {
        "pieces": [model.id_to_piece(i) for i in range(n)],
        "scores": [model.get_score(i) for i in range(n)],
        "kinds": kinds,
        "end": model.eos_id(),
    }


class Codec:
    """Encoder and decoder of one model in one process; memo tables are bounded."""

    def __init__(self, model: dict):
        self.pieces = model["pieces"]
        self.end = model["end"]
        kinds, scores = model["kinds"], model["scores"]
        self.ids = {p: i for i, p in enumerate(self.pieces) if kinds[i] == "normal"}
        self.rank = {p: -scores[i] for p, i in self.ids.items()}
        byte_ids = [i for i, k in enumerate(kinds) if k == "byte"]
        self.byte_id = {int(self.pieces[i][3:5], 16): i for i in byte_ids}
        self.inner = any(MARK in p.lstrip(MARK) for p in self.ids)
        #: pieces that merging can form at all
        self.formed = {p: i for p, i in self.ids.items() if self.merge(p) == [p]}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.formed.items():
            self.automaton.add_word(p, (len(p) - 1, i))
        self.automaton.make_automaton()
        self.size = [len(p) for p in self.pieces]
        #: of each piece, the next shorter piece that it begins with; -1: none
        self.shorter = [-1] * len(self.pieces)
        for p, i in self.formed.items():
            for k in range(len(p) - 1, 0, -1):
                if (q := self.formed.get(p[:k])) is not None:
                    self.shorter[i] = q
                    break
        letters = set("".join(self.ids))
        foreign = "".join(chr(c) for c in range(128) if chr(c) not in letters)
        # without pieces that hold a mark after other letters, nothing reaches across a mark; nor across a letter of no piece
        far = f"[{re.escape(foreign)}]|" if foreign else ""
        near = re.escape(foreign + MARK)
        self.split = re.compile(f"{far}{MARK}*[^{near}]+|{MARK}+" if not self.inner else f"{far}[^{re.escape(foreign)}]+", re.S).findall
        self.joinable = Memo(self._stays_apart, 800_000)
        self.memo = Memo(self._encode_part, 300_000)
        raw = [p.replace(MARK, " ").encode() if kinds[i] == "normal" else b"" for i, p in enumerate(self.pieces)]
        for value, i in self.byte_id.items():
            raw[i] = bytes([value])
        self.raw = raw
        self.odd = {i for i, k in enumerate(kinds) if k in ("control", "unknown")}
        self.text = list(map(str, range(len(self.pieces))))
        self.marked = {i for p, i in self.ids.items() if p.startswith(MARK)}
        self.silent = {i for i, k in enumerate(kinds) if k == "control"}
        self.unknown = {i for i, k in enumerate(kinds) if k == "unknown"}

    # ------------------------------------------------------------- encoding

    def merge(self, text: str) -> list[str]:
        """Plain merging by score, leftmost first: the definition that compatibility is checked against."""
        symbols, rank, none = list(text), self.rank.get, float("inf")
        ranks = [rank(a + b, none) for a, b in zip(symbols, symbols[1:])]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank(symbols[i - 1] + symbols[i], none)
            if i < len(ranks):
                ranks[i] = rank(symbols[i] + symbols[i + 1], none)
        return symbols

    def _stays_apart(self, pair: tuple[int, int]) -> bool:
        """Whether merging the spellings of two pieces gives those two pieces."""
        parts = [self.pieces[i] for i in pair]
        return self.merge("".join(parts)) == parts

    def _encode_part(self, part: str) -> list[int]:
        """Backtracking over a part whose letters may include ones that are in no piece."""
        n = len(part)
        if (whole := self.formed.get(part)) is not None:
            return [whole]
        longest = [-1] * n
        for last, (back, ident) in self.automaton.iter(part):  # ends ascend, so the longest piece of a start comes last
            longest[last - back] = ident
        fits, size, shorter, ids = self.joinable, self.size, self.shorter, self.formed
        dead = 0  # bit i: nothing leads on from place i
        starts: list[int] = []
        chosen: list[int] = []  # pieces; -1 for a letter that has none and stands alone, as bytes
        at, pick, alone = 0, longest[0], part[0] not in ids
        while at < n:
            last = chosen[-1] if chosen else -1
            while pick >= 0:
                if not dead >> (at + size[pick]) & 1 and (last < 0 or fits[last, pick]):
                    break
                pick = shorter[pick]
            if pick >= 0 or alone and not dead >> (at + 1) & 1:
                starts.append(at)
                chosen.append(pick)
                at += size[pick] if pick >= 0 else 1
                if at < n:
                    pick, alone = longest[at], part[at] not in ids
            else:
                dead |= 1 << at
                at, pick = starts.pop(), chosen.pop()
                alone = pick >= 0 and part[at] not in ids
                pick = shorter[pick] if pick >= 0 else -1
        out: list[int] = []
        for at, ident in zip(starts, chosen):
            if ident >= 0:
                out.append(ident)
            else:
                out += [self.byte_id[b] for b in part[at].encode()]
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of a text, the end id last."""
        out: list[int] = []
        if text:
            for ids in map(self.memo.__getitem__, self.split(MARK + text.replace(" ", MARK))):
                out += ids
        out.append(self.end)
        return out

    # ------------------------------------------------------------- decoding

    def decode(self, ids: list[int]) -> str:
        """Text of ids: the leading mark goes, control ids are silent, runs of byte pieces are read as UTF-8."""
        raw = b"".join(map(self.raw.__getitem__, ids))
        if next((i for i in ids if i not in self.silent), None) in self.marked:
            raw = raw[1:]
        if self.odd.isdisjoint(ids[:-1]) and self.unknown.isdisjoint(ids[-1:]):
            try:
                return raw.decode()
            except UnicodeDecodeError:
                pass
        return self._decode_broken(ids)

    def _decode_broken(self, ids: list[int]) -> str:
        """Byte runs that are no UTF-8: each byte that fits nowhere becomes U+FFFD."""
        out, run = [], bytearray()
        surface = " ⁇ "  # fixed value: what the library prints for the unknown id

        def flush() -> None:
            i = 0
            while i < len(run):
                for size in (4, 3, 2, 1):
                    try:
                        out.append(run[i : i + size].decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    size = 1
                i += min(size, len(run) - i)
            run.clear()

        of_byte = {i: v for v, i in self.byte_id.items()}
        first = True
        for i in ids:
            if i in of_byte:
                run.append(of_byte[i])
                first = False
                continue
            flush()
            if i in self.silent:
                continue
            if i in self.unknown:
                out.append(surface)
            else:
                piece = self.raw[i].decode()
                out.append(piece[1:] if first and i in self.marked else piece)
            first = False
        flush()
        return "".join(out)


_CODECS: dict[int, Codec] = {}


def _codec(model) -> Codec:
    if id(model) not in _CODECS:
        _CODECS.clear()
        _CODECS[id(model)] = Codec(model.value)
    return _CODECS[id(model)]


def encoded(docs: DataFrame, path: str, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(ident, ids): the ids of every whole text, the end id last. ``path`` is read once, on the driver."""
    model = docs.sparkSession.sparkContext.broadcast(load_model(path))

    def make(columns: list[list]) -> list[list]:
        codec = _codec(model)
        return [columns[0], [codec.encode((t or b"").decode()) for t in columns[1]]]

    kind = docs.schema[ident].dataType.simpleString()
    return per_batch(text_rows(docs, ident, text), make, f"`{ident}` {kind}, ids array<int>")


def decoded(rows: DataFrame, path: str, ident: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(ident, text) from lists of ids; a null list decodes to an empty text."""
    model = rows.sparkSession.sparkContext.broadcast(load_model(path))

    def make(columns: list[list]) -> list[list]:
        codec = _codec(model)
        return [columns[0], [codec.decode(x or []) for x in columns[1]]]

    kind = rows.schema[ident].dataType.simpleString()
    return per_batch(rows.select(ident, ids), make, f"`{ident}` {kind}, text string")


def digests(docs: DataFrame, path: str, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(ident, n_tokens, ids_sha256, decoded_sha256): every text encoded and decoded again in one pass, without a shuffle."""
    model = docs.sparkSession.sparkContext.broadcast(load_model(path))

    def make(columns: list[list]) -> list[list]:
        codec = _codec(model)
        sizes, ids_hex, text_hex = [], [], []
        for t in columns[1]:
            ids = codec.encode((t or b"").decode())
            sizes.append(len(ids))
            ids_hex.append(hashlib.sha256(" ".join(map(codec.text.__getitem__, ids)).encode()).hexdigest())
            text_hex.append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
        return [columns[0], sizes, ids_hex, text_hex]

    kind = docs.schema[ident].dataType.simpleString()
    return per_batch(text_rows(docs, ident, text), make, f"`{ident}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
