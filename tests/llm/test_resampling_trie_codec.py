"""Bit-plane resampling, prefix trie and byte codec against plain loops and the library, with odd tables."""

import hashlib
import math
import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from curaspark.llm import byte_codec, plane_resampling, prefix_trie

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN

# ------------------------------------------------------------------ bit planes


def test_plane_sums_are_exact():
    rng = np.random.default_rng(4)
    for low, high, most in ((-9000, 9000, 3), (-1, 0, 1), (0, 0, 900), (5, 77, 20_000), (-(1 << 40), 1 << 40, 7)):
        gains = rng.integers(low, high + 1, 10_000)
        planes, powers = plane_resampling.signed_planes(gains)
        counts = rng.integers(0, most + 1, 10_000)
        assert plane_resampling.plane_sum(plane_resampling.planes_of(counts, int(most).bit_length()), planes, powers) == int(counts @ gains)


def _resampled(docs, target, percent):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    bucket = lambda w: zlib.crc32(w.encode()) % 10_000
    seen, wanted = [0] * 10_000, [0] * 10_000
    for _, t in docs:
        for w in words(t):
            seen[bucket(w)] += 1
    for _, t in target:
        for w in words(t):
            wanted[bucket(w)] += 1
    S, T = sum(seen), sum(wanted)
    gain = [math.floor(1000 * math.log((t + 1) * (S + 10_000) / ((s + 1) * (T + 10_000)))) for s, t in zip(seen, wanted)]
    rows = []
    for ident, t in docs:
        found = words(t)
        weight = sum(gain[bucket(w)] for w in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if ident is None else ident}".encode()).hexdigest()[:8], 16)
        rows.append((ident, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = fit[: percent * len(fit) // 100]
    return sorted([(*r, k + 1) for k, r in enumerate(drawn)] + [(*r, None) for r in fit[len(drawn) :]] + [(*r, None) for r in rows if r[1] < 20], key=str)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    vocabulary = [f"Word{i}" for i in range(300)] + ["naïve", "中文", "x9", "it's"]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 3, 25, 60])))) for i in range(120)]
    docs += [(200, None), (201, ""), (202, "-- \n"), (7, docs[7][1]), (7, "short"), (None, " ".join(vocabulary[:40])), (203, " ".join(rng.choices(vocabulary, k=20_000)))]
    docs += [(i, docs[3][1] + " same" * 30) for i in range(300, 340)]
    return docs, [(1, "Word1 word2 WORD2 naïve"), (2, None), (3, "it's 中文")]


@pytest.mark.parametrize("percent", [10, 100, 0])
def test_resampling_equals_plain_loop(spark, texts, percent):
    docs, target = texts
    table = spark.createDataFrame([(i, t, 1.0, "s") for i, t in docs], "doc_id bigint, text string, score double, rank string")
    got = plane_resampling.resampled(table, spark.createDataFrame(target, "item_id bigint, text string"), percent)
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got.collect()), key=str) == _resampled(docs, target, percent)


def test_resampling_of_empty_tables(spark, texts):
    docs = spark.createDataFrame(texts[0], "doc_id bigint, text string")
    empty = docs.limit(0)
    assert plane_resampling.resampled(empty, docs).count() == 0
    assert sorted((r.doc_id or -1, r.score) for r in plane_resampling.resampled(docs, empty).collect()) == sorted((r[0] or -1, r[3]) for r in _resampled(texts[0], [], 10))


def test_runs_of_several_words(spark):
    find = plane_resampling.Buckets(10_000, 2)
    assert list(find([b"a", b"b", b"c"])) == [zlib.crc32(x) % 10_000 for x in (b"a", b"b", b"c", b"a b", b"b c")]


# ------------------------------------------------------------------ prefix trie


def _nodes(convs):
    """convs: id -> list of (role, text)."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for prefix, ids in members.items():
        below = [p for p in members if p[: len(prefix)] == prefix]
        kids = [p for p in below if len(p) == len(prefix) + 1]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below)]
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        ends = ",".join(map(str, sorted(c for c in ids if len(convs[c]) == len(prefix))))
        parent = min(members[prefix[:-1]]) if prefix else None
        out.append((min(ids), len(prefix), parent, len(ids), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def _random_conversations(rng, n, said, longest):
    convs = {}
    for c in range(n):
        if convs and rng.random() < 0.5:
            base = convs[rng.choice(list(convs))]
            turns = base[: rng.randint(0, len(base))] + [(rng.choice("ua"), rng.choice(said)) for _ in range(rng.randint(0, 3))]
        else:
            turns = [(rng.choice("ua"), rng.choice(said)) for _ in range(rng.randint(0, longest))]
        convs[c] = turns
    return convs


@pytest.mark.parametrize("shape", ["random", "comb", "chain", "copies"])
def test_trie_equals_brute_force(spark, monkeypatch, shape):
    rng = random.Random(shape)
    if shape == "random":
        convs = _random_conversations(rng, 250, ["", "é", "yes", "no", "well then"], 9)
    elif shape == "comb":
        convs = {c: [("u", str(k)) for k in range(c)] + [("a", "off")] for c in range(40)}
    elif shape == "chain":
        convs = {-c: [("u", "again")] * c for c in range(33)}
    else:
        convs = {c: [("u", "hi"), ("a", "x" * (c % 3))] for c in range(400)} | {1000: []}
        monkeypatch.setattr(prefix_trie, "CHUNK", 64)
        monkeypatch.setattr(prefix_trie, "HOT_SHARE", 0.0)
    rows = [(c, [(hashlib.md5(f"{len(r)}:{r}{t}".encode()).digest(), len(t.encode())) for r, t in turns]) for c, turns in convs.items()]
    given = spark.createDataFrame(rows, "conv bigint, turns array<struct<digest: binary, bytes: bigint>>")
    got = prefix_trie.nodes(given).drop("prefix")
    assert sorted((tuple(r) for r in got.collect()), key=str) == _nodes(convs)


def test_turn_lists(spark):
    rows = [(1, 2, "a", "B", 0), (1, None, "u", None, 0), (1, 2, None, "c", 0), (1, 2, "a", "B", 0), (None, 1, "u", "x", 0), (2, 5, "", "é", 0)]
    given = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, turns int")
    got = {r.conv: [(bytes(t.digest), t.bytes) for t in r.turns] for r in prefix_trie.turn_lists(given).collect()}
    say = lambda role, text: (hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), len(text.encode()))
    assert got == {1: [say("u", ""), say("", "c"), say("a", "B"), say("a", "B")], 2: [say("", "é")]}
    assert prefix_trie.nodes(prefix_trie.turn_lists(given.limit(0))).count() == 0


def test_two_fattest(spark):
    pairs = [(a, b) for a in range(40) for b in range(a + 1, 41)]
    got = spark.createDataFrame(pairs, "a int, b int").select("a", "b", prefix_trie.two_fattest("a", "b").alias("f")).collect()
    assert all(r.f == max(range(r.a + 1, r.b + 1), key=lambda x: x & -x) for r in got)


# ------------------------------------------------------------------ byte codec


@pytest.fixture(scope="module")
def ranks():
    return byte_codec.load_ranks(RANKS)


@pytest.mark.parametrize("leaf", [1, 3, 64])
def test_codec_equals_library(ranks, leaf):
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = byte_codec.Codec(ranks, PATTERN, byte_codec.newer_characters(PATTERN), leaf)
    rng = random.Random(leaf)
    alphabets = ["ab", "a", "aeiouthn", "abcdefghijklmnopqrstuvwxyz", " \n\tab", "héo中ая𝔘'l1.՘\U00010940", "<|endoftext|> x", "=-", "0123456789", "中文字符"]
    texts = ["", " ", "\x00\x1c\x85\xa0​", "x" * 20_000, "ab" * 9000, "=" * 5001, "word " * 3000]
    texts += ["".join(rng.choices(rng.choice(alphabets), k=rng.choice([3, 10, 40, 300]))) for _ in range(2000)]
    for t in texts:
        packed = codec.encode(t)
        assert list(struct.unpack(f"<{len(packed) // 4}I", packed)) == library.encode_ordinary(t)
        assert codec.decode(packed) == t.encode()


def test_join_of_any_halves(ranks):
    codec = byte_codec.Codec(ranks, PATTERN)
    rng = random.Random(1)
    for _ in range(3000):
        piece = bytes(rng.choices(rng.choice([b"ab", b"the in", b"\xc3\xa9\xe4", bytes(range(256))]), k=rng.randint(0, 60)))
        at = rng.randint(0, len(piece))
        assert codec.join(byte_codec.merge(piece[:at], ranks), byte_codec.merge(piece[at:], ranks)) == byte_codec.merge(piece, ranks)


def test_unfit_ranks_are_refused(tmp_path):
    import base64

    tokens = [bytes([b]) for b in range(256)] + [b"abc"]  # abc cannot be reached by merging pairs
    (tmp_path / "odd.tiktoken").write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens)))
    with pytest.raises(ValueError):
        byte_codec.load_ranks(str(tmp_path / "odd.tiktoken"))


def test_codec_tables(spark, ranks):
    rows = [(1, "a b", 9), (None, "é", 8), (3, None, 7), (1, "a b", 9), (4, "word " * 2000, 0), (5, "", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int")
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t, _ in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = byte_codec.digests(docs, RANKS, PATTERN)
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)
    assert byte_codec.digests(docs.limit(0), RANKS, PATTERN).count() == 0
    back = byte_codec.decoded(byte_codec.encoded(docs, RANKS, PATTERN), RANKS, PATTERN)
    assert sorted((r.doc_id or 0, r.text) for r in back.collect()) == sorted((i or 0, t or "") for i, t, _ in rows)
