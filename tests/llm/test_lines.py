import random
import re
from collections import Counter

from keyclock.llm import line_dedup, line_quality

SCHEMA = "doc_id long, text string, d string, kept int"


def measures(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside)


def test_base_measures_against_plain_python(spark):
    rnd = random.Random(4)
    texts = [None, "", " \n\t ", "one", "a b c d e a b c d e", "a b c d e f a b c d e", "x " * 3000, "é ü # * | ñ\x0bz\x0cq\r\nend", "l1\nl1\n\nl1 \nl1"]
    for _ in range(150):
        texts.append("".join(rnd.choice(["a", "b", "c", "dd", "é"]) + rnd.choice([" ", " ", "\n", "  ", "\t"]) for _ in range(rnd.randint(1, 80))))
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], SCHEMA)
    for r in line_quality.assessed(docs).collect():
        want = measures(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, texts[r.doc_id]
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.kept and r.base_failed)


def test_lines_go_first_then_documents(spark):
    prose = "Here is a sentence with some words that ends well.\nAnother one follows it, just as long as the first!"
    texts = [prose, f"Home | News | Sports | More\n{prose}\nAll rights reserved.", "No end here at all in this line\n" * 12 + prose[:20], "ALL!! WORDS!! SHOUT!! AT!! YOU!! IN!! THIS!! LINE!! AND!! ON!! GO!!"]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r for r in line_quality.assessed(docs).collect()}
    assert [got[i].kept for i in range(4)] == [True, True, False, False]
    assert got[0].cleaned_text == got[1].cleaned_text == prose
    assert line_quality.assessed(docs.limit(0)).collect() == []


def brute(docs, least=40):
    """Line numbers to be deleted: whole runs from the definition, by looking at every earlier place."""
    held = {}
    for k, text in docs.items():
        own = [(x.strip(" \t\n\x0b\f\r"), i) for i, x in enumerate((text or "").split("\n"))]
        held[k] = [(x, len(x.split()), i) for x, i in own if x]
    seen, out = {}, {k: set() for k in docs}
    for k in sorted(held):
        lines = held[k]
        for j in range(len(lines)):
            e, n = j, lines[j][1]
            while n < least and e + 1 < len(lines):
                e += 1
                n += lines[e][1]
            if n < least:
                break
            key = tuple(x for x, _, _ in lines[j : e + 1])
            if key not in seen:
                seen[key] = (k, j, e)
                continue
            fk, fj, fe = seen[key]
            other, b, c = held[fk], j, e
            while b > 0 and fj - (j - b) - 1 >= 0 and lines[b - 1][0] == other[fj - (j - b) - 1][0]:
                b -= 1
            while c + 1 < len(lines) and fe + (c - e) + 1 < len(other) and lines[c + 1][0] == other[fe + (c - e) + 1][0]:
                c += 1
            out[k] |= {lines[i][2] for i in range(b, c + 1)}
    return {k: sorted(v) for k, v in out.items()}


def documents():
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    line = lambda n: " ".join(rnd.choices(words, k=n))
    passages = [[line(rnd.randint(3, 25)) for _ in range(rnd.randint(1, 8))] for _ in range(12)] + [[line(55)]]
    docs = {}
    for i in range(120):
        lines = []
        for _ in range(rnd.randint(1, 6)):
            lines += rnd.choice(passages) if rnd.random() < 0.5 else [line(rnd.randint(1, 20)), ""]
            if rnd.random() < 0.2:
                p = rnd.choice(passages)
                lines += p[: rnd.randint(1, len(p))]
        docs[i] = "\n".join(lines)
    docs[200] = "\n".join([passages[-1][0]] * 5 + ["tail"])
    docs[201] = docs[3]
    docs[202] = "  " + docs[4].replace("\n", " \r\n\t")
    docs[203] = None
    return docs


def test_deleted_lines_against_all_earlier_places(spark):
    docs = documents()
    frame = spark.createDataFrame([(k, t, "x", 1) for k, t in docs.items()], SCHEMA).repartition(5)
    got = {r.doc_id: list(r.removed_lines) for r in line_dedup.summary(frame).collect()}
    want = brute(docs)
    assert got == want
    assert sum(map(len, want.values())) > 100 and not want[0]
    texts = {r.doc_id: r.text for r in line_dedup.deduplicated(frame).collect()}
    for k, text in docs.items():
        assert texts[k] == (None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in want[k]))


def test_repeated_rows_null_ids_and_nothing(spark):
    long = " ".join(f"v{i}" for i in range(60))
    docs = spark.createDataFrame([(1, long, "x", 1), (1, long, "x", 1), (None, long, "x", 1), (2, "short", "x", 1)], SCHEMA)
    got = sorted((r.doc_id or 0, r.n_removed, r.words_removed) for r in line_dedup.summary(docs).collect())
    assert got == [(0, 1, 60), (1, 0, 0), (1, 0, 0), (2, 0, 0)]
    assert line_dedup.summary(docs.limit(0)).collect() == []
    assert line_dedup.deduplicated(docs.limit(0)).columns == docs.columns
