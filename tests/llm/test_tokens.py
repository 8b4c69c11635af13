import random
import zlib

import numpy as np
import pytest

from keyclock.llm import simple8b, token_counts, token_files
from keyclock.llm.queries import vocabulary
from keyclock.llm.shared import shared_folder

SCHEMA = "doc_id long, text string, start long, ids string"
PIECES = ["\x1c", "'", "s", "t", "r", "e", "v", "l", "m", "d", "a", "Z", " ", " ", " ", "\n", "\t", " ", "1", "٣", "!", "é", "日", "😀", "<|endoftext|>", "hello", " world"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


def texts():
    rnd = random.Random(1)
    fixed = ["", " ", "  ", "'s", "'re'", "'r", "'l", "it's we're 'll x", "\n\n abc", "  x", "a<|endoftext|> b<|endoftext|>", "!'s ''s", "x" * 1500, " " * 700 + "a", "\t\t\tx\n", "é" * 513]
    return fixed + ["".join(rnd.choice(PIECES) for _ in range(rnd.choice([5, 40, 900]))) for _ in range(400)]


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA)


def test_counts_equal_the_library(spark, library):
    rows = [*enumerate(texts()), (None, "null id"), (7, None)]
    want = sorted((i if i is not None else -1, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    got = token_counts.token_counts(table(spark, rows), vocabulary(), limit=20).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 20) for r in got)
    assert token_counts.token_counts(table(spark, []), vocabulary()).collect() == []


def test_counts_survive_forgetting(library, monkeypatch):
    monkeypatch.setattr(token_counts, "MOST_STATES", 50)
    monkeypatch.setattr(token_counts, "MOST_PIECES", 20)
    count, some = token_counts.counter(vocabulary()), texts()[:120]
    assert [count([t])[0] for t in some] == [len(library.encode(t, add_special_tokens=False).ids) for t in some]


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        token_counts.counter(vocabulary("word_bpe_49k.json"))


def test_files_round_trip(spark, library):
    rows = [(3 * i - 50, t) for i, t in enumerate(texts())] + [(None, "last"), (5, None), (5, "same id")]
    random.Random(2).shuffle(rows)
    docs = table(spark, rows).repartition(6)
    path = shared_folder(spark)
    token_files.write(docs, path, vocabulary())
    got = token_files.read(spark, path).collect()
    want = sorted((i is None, i or 0, (*library.encode(t or "", add_special_tokens=False).ids, 2)) for i, t in rows)
    own = sorted(got, key=lambda r: r.start)
    assert sorted((r.doc_id is None, r.doc_id or 0, tuple(r.ids)) for r in own) == want
    assert [r.doc_id for r in own] == [None if none else i for none, i, _ in want]
    at = 0
    for r in own:
        assert (r.start, r.n_tokens) == (at, len(r.ids))
        at += r.n_tokens
    sums = {(r.start, r.ids_crc32) for r in token_files.read(spark, path, "crc32").collect()}
    assert sums == {(r.start, zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in own}
    assert token_files.encode_and_check(table(spark, []), vocabulary()).collect() == []


def test_a_vocabulary_that_cannot_be_cut_is_encoded_whole():
    from tokenizers import Tokenizer

    name = vocabulary("word_bpe_49k.json")
    library, some = Tokenizer.from_file(name), texts()[:60]
    got = token_files.encoder(name)(some)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids for t in some]


def test_words_cut_at_marks_equal_the_library(library, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(token_files, "MEMO", 60)
    rnd = random.Random(4)
    ends = ["", "", ".", ",%%%", "$$$", "!?!?!?!?!", "'s,", "''.", "|>", "<|endoftext|>", "<|endoftext|>.", "\u00a0", "\x1c", "\u3000", ")", "»."]
    word = lambda: "".join(rnd.choice("aZé×÷ɏɐñ日ßü19'.$\u0301") for _ in range(rnd.randrange(4))) + rnd.choice(ends)
    some = ["a", "", "é", "x.", *("".join(word() + rnd.choice([" ", " ", " ", "\n"]) for _ in range(rnd.randrange(9))) + "end" for _ in range(3000))]
    want = [e.ids for e in library.encode_batch(some, add_special_tokens=False)]
    encode, told = token_files.encoder(vocabulary()), []
    for i in range(0, len(some), 50):
        told += encode(pa.array(["skipped", *some[i : i + 50]])[1:])
    assert [np.frombuffer(x, "<u4").tolist() for x in told] == want
    assert [np.frombuffer(x, "<u4").tolist() for x in token_files.encoder(vocabulary())(some)] == want
    assert encode([]) == []


def test_distinct_words_go_to_the_library_together(library, monkeypatch):
    import tokenizers

    calls = []

    class Counted:
        def __init__(self, inner):
            self.inner = inner

        def __getattr__(self, name):
            got = getattr(self.inner, name)
            return Counted(got) if name == "model" else got

        def tokenize(self, word):
            calls.append(word)
            return self.inner.tokenize(word)

        def encode_batch_fast(self, texts, **how):
            calls.extend(texts)
            return self.inner.encode_batch_fast(texts, **how)

    monkeypatch.setattr(tokenizers, "Tokenizer", type("T", (), {"from_file": lambda path: Counted(library)}))
    rnd = random.Random(6)
    words = sorted({"".join(rnd.choice("abcdeé") for _ in range(9)) for _ in range(3000)})
    text = "so " + " ".join(w + m for w in words for m in ("", ".", "$$$"))
    encode = token_files.encoder(vocabulary())
    calls.clear()
    (ids,) = encode([text])
    assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(calls) < 100 and sum(map(len, calls)) < 11 * len(words)
    calls.clear()
    long = "日本" * 500
    assert [len(x) // 4 for x in encode([long, long, ""])] == [len(library.encode(long).ids)] * 2 + [0]
    assert sum(map(len, calls)) == 1000


@pytest.mark.parametrize("n", [0, 1, 2, 59, 60, 61, 1023, 1024, 1025, 5000])
def test_simple8b_with_escapes(n):
    rng = np.random.default_rng(n)
    for high in (1, 2, 1 << 10, 1 << 40, 1 << 63):
        values = rng.integers(0, high, n, dtype=np.uint64, endpoint=True)
        values = np.where(rng.random(n) < 0.5, values, values >> np.uint64(20))
        words, offsets, exceptions = simple8b.pack(values)
        assert (simple8b.unpack(words, exceptions, offsets) == values).all()
        assert len(offsets) == -(-n // simple8b.BLOCK)
        if n:
            second = np.append(offsets, len(words))[1]
            assert (simple8b.unpack(words[:second], exceptions, offsets[:1]) == values[: simple8b.BLOCK]).all()
            for wrong in (offsets[:-1], offsets + np.uint32(1), np.sort(np.append(offsets[1:], 1)).astype(np.uint32)):
                with pytest.raises(ValueError, match="offsets"):
                    simple8b.unpack(words, exceptions, wrong)
