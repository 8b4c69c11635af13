import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from keyclock.llm import byte_bpe, queries

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, ids string, bytes int"


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.read_ranks(RANKS)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def odd_texts(rnd, n):
    """Spacing, marks, scripts and long words put together at random."""
    parts = [" ", "  ", "\n", "\n\n", " \n ", "\t", "\r\n", " ", "\x1c", " ", "\x85", "'s", "'ll", "'", "l", "re", "don't", "x", "1", "2024", "!", "...", "é", "Straße", "中文", "日本語", "🙂", "👩‍👩‍👧", "a" * 40, "ab" * 30, "=" * 50, "words", "The", "quick", "́", "ß", "0" * 33]
    return ["".join(rnd.choices(parts, k=rnd.randint(1, 400))) for _ in range(n)]


def test_every_token_is_the_encoding_of_its_bytes(ranks):
    encoder = byte_bpe.TreeEncoder(ranks, public_tokenizers.PATTERN)
    assert all(encoder.merged(token) == [rank] for token, rank in ranks.items())


@pytest.mark.parametrize("leaf", [2, 7, 40, 512])
def test_odd_texts_against_the_library(ranks, library, leaf):
    encoder = byte_bpe.TreeEncoder(ranks, public_tokenizers.PATTERN, leaf=leaf)
    for text in odd_texts(random.Random(leaf), 400):
        ids = encoder.encode(text)
        assert ids.tolist() == library(text)
        assert encoder.decode(ids) == text.encode()


def test_without_places_to_break(ranks, library):
    encoder = byte_bpe.TreeEncoder(ranks, public_tokenizers.PATTERN, breaks=None, leaf=20)
    for text in odd_texts(random.Random(9), 100):
        assert encoder.encode(text).tolist() == library(text)


def test_matches_without_end(ranks, library):
    encoder = byte_bpe.TreeEncoder(ranks, public_tokenizers.PATTERN)
    rnd = random.Random(3)
    for text in ("a" * 20_001, "ab" * 9000, "".join(rnd.choices("etaoinshr", k=20_000)), " " * 5000 + "x", "\n" * 3001, "é" * 3000, "0123456789" * 700, "中" * 2000, "=-" * 2000 + " a " + "z" * 3000):
        assert encoder.encode(text).tolist() == library(text)


def test_seams_of_one_match_at_every_place(ranks):
    encoder = byte_bpe.TreeEncoder(ranks, public_tokenizers.PATTERN)
    rnd = random.Random(4)
    for _ in range(60):
        piece = "".join(rnd.choices(["in", "ter", "nation", "al", "aaaa", "e", "ß", "tion", "s"], k=12)).encode()
        whole = encoder.merged(piece)
        for i in range(1, len(piece)):
            assert encoder._seam(encoder.merged(piece[:i]), encoder.merged(piece[i:])) == whole


def test_tables(spark, library):
    texts = ["", None, "one two", "one two", "x " * 30_000, *odd_texts(random.Random(5), 40)]
    docs = spark.createDataFrame([*((i, t, "clash", 1) for i, t in enumerate(texts)), (None, "no id", "clash", 1)], SCHEMA)
    got = {r.doc_id: r for r in byte_bpe.round_trips(docs, RANKS, public_tokenizers.PATTERN).collect()}
    assert len(got) == len(texts) + 1
    for i, t in [*enumerate(texts), (None, "no id")]:
        raw = b"".join(x.to_bytes(4, "little") for x in library(t or ""))
        assert got[i].n_tokens == len(raw) // 4
        assert got[i].ids_sha256 == hashlib.sha256(raw).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert byte_bpe.round_trips(spark.createDataFrame([], SCHEMA), RANKS, public_tokenizers.PATTERN).collect() == []


def test_query_against_the_library(spark, sf_dir, library):
    texts = {r.doc_id: r.text or "" for r in queries.table(spark, sf_dir, "documents").select("doc_id", "text").collect()}
    for r in queries.QUERIES["op12_byte_bpe"](spark, sf_dir).collect():
        raw = b"".join(x.to_bytes(4, "little") for x in library(texts[r.doc_id]))
        assert (r.n_tokens, r.ids_sha256) == (len(raw) // 4, hashlib.sha256(raw).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
