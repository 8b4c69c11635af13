import re

from keyclock.llm import surrogates as S

SCHEMA = "doc_id long, text string, d string, kind int"
TEXTS = {
    1: "Write to Anna.Berg@mail.example.com or +1 (319) 555-5132, from 79.197.74.40 today.",
    2: "anna.berg@mail.example.com again; call +1 319 555 5132. Card 4418452524842581 end",
    3: 'a token = "0641917ea4e9feb9cda83477b57ac2654884f485" and password=e3b3ed3cc8548923d6 too',
    4: "Mr. Smith met Mrs. Jones; Mr. Smith left. Господин Иванов here. MR. is not a name",
    5: "nothing to find here: 12, 3.4, v1.2.3.4.5 and a=b",
    6: None,
    7: "",
}


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def run(spark, texts, key="k"):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in texts.items()], SCHEMA)
    return {r.doc_id: r for r in S.replaced(docs, key).collect()}


def test_forms_coreference_and_keys(spark):
    got = run(spark, TEXTS)
    assert [got[i].n_entities for i in range(1, 8)] == [3, 3, 2, 4, 0, 0, 0]
    assert [got[i].text for i in (5, 6, 7)] == [TEXTS[5], None, ""]
    mail, phone, ip = got[1].surrogates
    assert re.fullmatch(r"[a-z]{4}\.[a-z]{4}@[a-z]{4}\.[a-z]{7}\.com", mail) and mail != "anna.berg@mail.example.com"
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", phone) and re.fullmatch(r"\d+\.\d+\.\d+\.\d+", ip)
    assert got[2].surrogates[0] == mail
    assert re.sub(r"\D", "", got[2].surrogates[1]) == re.sub(r"\D", "", phone) and re.fullmatch(r"\+1 \d{3} \d{3} \d{4}", got[2].surrogates[1])
    card = got[2].surrogates[2]
    assert len(card) == 16 and card[0] == "4" and luhn(card) and card != "4418452524842581"
    assert re.fullmatch(r'token = "[0-9a-f]{40}"', got[3].surrogates[0]) and re.fullmatch(r"password=[0-9a-f]{18}", got[3].surrogates[1])
    smith, jones, again, ivanov = got[4].surrogates
    assert smith == again and re.fullmatch(r"Mr\. [A-Z][a-z]{4}", smith) and re.fullmatch(r"Mrs\. [A-Z][a-z]{4}", jones)
    assert re.fullmatch(r"Господин [А-Я][а-я]{5}", ivanov)
    for i, t in TEXTS.items():
        if got[i].n_entities:
            for x in re.findall(r"[\w.]+@[\w.]+|\d{6,}|\d+\.\d+\.\d+\.\d+|Smith|Jones|Иванов|e3b3ed3cc8548923d6", t):
                assert x not in got[i].text
    assert run(spark, TEXTS, "other")[1].surrogates != got[1].surrogates


def test_surrogates_stay_distinct(spark):
    texts = {i: f"call 555-0{i % 100:02d}-{i // 100:04d} or mail a{i % 10}@b.io" for i in range(1500)}
    got = run(spark, texts)
    numbers = {texts[i].split()[1]: r.surrogates[0] for i, r in got.items()}
    mails = {texts[i].split()[-1]: r.surrogates[1] for i, r in got.items()}
    assert len(set(numbers.values())) == len(numbers) == 1500
    assert len(set(mails.values())) == len(mails) == 10
    assert not set(numbers.values()) & set(numbers) and not set(mails.values()) & set(mails)


def test_repeated_rows_clashing_columns_and_nothing(spark):
    docs = spark.createDataFrame([(None, TEXTS[1], 3), (None, TEXTS[1], 4), (2, TEXTS[1], 5)], "doc_id long, text string, n_entities int")
    got = S.replaced(docs, "k").collect()
    assert len(got) == 3 and len({r.text for r in got}) == 1 and {r.n_entities for r in got} == {3}
    assert S.replaced(docs.limit(0), "k").collect() == []


def test_whole_names_and_later_mentions_without_a_title(spark):
    text = "Mrs. Anna Müller met Dr. O'Brien and Prof. Dr. Anne-Marie von Berg. Later Müller left, Berg too; MÜLLER and O'Brien wrote. Mülleria stays."
    got = run(spark, {1: text, 2: "Müller has no title here"})
    out = got[1].text
    assert not re.search(r"Anna|Müller(?!ia)|MÜLLER|Brien|Anne|Marie|Berg", out) and "Mülleria stays" in out
    found = re.fullmatch(r"Mrs\. (\w{4}) (\w{6}) met Dr\. (\w'\w{5}) and Prof\. Dr\. \w{4}-\w{5} von (\w{4})\. Later (\w{6}) left, (\w{4}) too; (\w{6}) and (\w'\w{5}) wrote\. Mülleria stays\.", out)
    assert found and found[2] == found[5] and found[7] == found[2].upper() and found[4] == found[6] and found[3] == found[8]
    assert got[1].n_entities == 9 and got[2].text == "Müller has no title here"


def test_full_forms_get_longer(spark):
    """All names of two letters, and 26 users on 16 hosts of one letter: no original is a surrogate, so some must be longer."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = {i: "Mr. " + a.upper() + b for i, (a, b) in enumerate((a, b) for a in letters for b in letters)}
    texts |= {1000 + i: f"write to {u}@{h}.io" for i, (u, h) in enumerate((u, h) for u in letters for h in letters[:16])}
    texts[5000] = "Mr. Ab and Mr. AB"
    got = run(spark, texts)
    names = {texts[i][4:].lower(): r.surrogates[0][4:].lower() for i, r in got.items() if i < 1000}
    assert len(names) == 676 and len(set(names.values())) == 676 and not set(names) & set(names.values())
    mails = {texts[i].split()[-1]: r.surrogates[0] for i, r in got.items() if 1000 <= i < 5000}
    assert len(set(mails.values())) == len(mails) == 416 and not set(mails) & set(mails.values())
    hosts = {}
    for a, b in mails.items():
        assert hosts.setdefault(a.split("@")[1], b.split("@")[1]) == b.split("@")[1]
    assert len(set(hosts.values())) == 16 and not set(hosts) & set(hosts.values())
    one, two = got[5000].surrogates
    assert one.lower() == two.lower() and two[4:] == two[4:].upper()


def test_accounts_numbers_and_scripts(spark):
    texts = {
        1: "pay DE89 3704 0044 0532 0130 00 or GB29NWBK60161331926819, SSN 123-45-6789, phone +1 319 555 5132",
        2: "Mr. 王小明 wrote; 王小明说好. version 1.2.3.4 and v10.0.0.1 stay, host 10.0.0.1 goes",
        3: "Ask Dr. The answer is here. The answer stays, Dr. Who-Knows too",
    }
    got = run(spark, texts)
    out = got[1].text
    found = re.fullmatch(r"pay (DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d) or (GB\d\d[A-Z]{4}\d{14}), SSN (\d{3}-\d{2}-\d{4}), phone \+1 \d{3} \d{3} \d{4}", out)
    assert found and found[3] != "123-45-6789" and "3704 0044" not in out and "NWBK" not in out
    for account in (found[1].replace(" ", ""), found[2]):
        assert int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1
    assert "王小明" not in got[2].text and "version 1.2.3.4 and v10.0.0.1 stay" in got[2].text and "host 10.0.0.1" not in got[2].text
    name = got[2].surrogates[0][4:]
    assert got[2].text.count(name) == 2 and len(name) == 3
    assert got[3].text.startswith("Ask Dr. The answer is here. The answer stays")
