"""Token operators against the libraries whose vocabularies they read."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from curaspark.llm import bpe_count, piece_codec

PIECE = public_tokenizers.path("piece_bpe_32k.model")
BYTE = public_tokenizers.path("byte_bpe_50k.json")

ODD = [
    "", " ", "   ", "a", "The cat  sat.\n\tOn <s> the </s> mat <0x41>", "<|endoftext|>", "x<|endoftext|>  y<|endoftext",
    "▁▁ a▁b", "naïve 中文字符 🎉 é́ ﬁ", "\x00\x1c\x85\xa0​", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaab", "it's 'll 12345 ١٢٣",
    "֋Ᲊ\U00010940", "word " * 3000, "x" * 5000,
]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    letters = "ab te▁ \n<s>héo中ая𝔘'l1."
    return ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]


def test_codec_equals_library(texts):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    codec = piece_codec.Codec(piece_codec.load_model(PIECE))
    for t in texts:
        ids = codec.encode(t)
        assert ids == library.encode(t, add_eos=True)
        assert codec.decode(ids) == library.decode(ids)


def test_decode_any_ids():
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    codec = piece_codec.Codec(piece_codec.load_model(PIECE))
    rng = random.Random(7)
    for _ in range(3000):
        ids = [rng.choice([0, 1, 2, rng.randint(3, 258), rng.randint(259, 31999)]) for _ in range(rng.randint(0, 9))]
        assert codec.decode(ids) == library.decode(ids)


def test_counts_equal_library(texts):
    library = Tokenizer.from_file(BYTE)
    counter = bpe_count.Counter(bpe_count.load_vocabulary(BYTE))
    assert [counter.count(t) for t in texts] == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_token_queries(spark):
    rows = [(1, "a b", 9), (None, "é", 8), (3, None, 7), (1, "a b", 9), (4, "word " * 2000, 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int")
    got = sorted((tuple(r) for r in bpe_count.token_counts(docs, BYTE).collect()), key=str)
    assert got == sorted([(1, 3, 2, False), (None, 2, 1, False), (3, 0, 0, False), (1, 3, 2, False), (4, 10000, 2001, True)], key=str)
    assert bpe_count.token_counts(docs.limit(0), BYTE).count() == 0
    out = {r.doc_id: r for r in piece_codec.digests(docs, PIECE).collect()}
    assert out[3].n_tokens == 1 and out[3].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert out[4].decoded_sha256 == hashlib.sha256(("word " * 2000).encode()).hexdigest()
    back = piece_codec.decoded(piece_codec.encoded(docs, PIECE), PIECE)
    assert sorted((r.doc_id or 0, r.text) for r in back.collect()) == sorted((i or 0, t or "") for i, t, _ in rows)
