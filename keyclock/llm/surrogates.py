"""Personal data is replaced by keyed surrogates of the same type and form. DataFrame operations only.

Found are e-mail addresses, phone numbers, IPv4 addresses (not after "version" or "v"), payment card and bank account numbers (IBAN), social
security numbers (123-45-6789), secrets given as ``token = "..."`` or ``password=...``, and names after a title: all their words, hyphens and
apostrophes included, each as an entity of its own wherever else it stands in the text (particles such as "von" stay, as do function words,
and names that no title announces anywhere in the text are not found; of a script without capitals up to three characters are taken). Every distinct entity (its canonical form: digits of numbers, lower case of addresses and names) gets one surrogate
from a keyed hash, so that an entity is the same everywhere it is mentioned and cannot be guessed without the key:

* numbers keep length, grouping and country code; cards keep their first digit, cards and accounts a right check digit or two; addresses
  keep four parts of 1 to 254;
* e-mail addresses keep punctuation, letters for letters and digits for digits; a domain is an entity of its own, with one surrogate;
* secrets keep their alphabet (hexadecimal digits, letters, digits); names keep the title and so the gender, the script (Latin, Greek,
  Cyrillic, Han, Hebrew, Arabic, Kana or Hangul), capital letters and the length.

Surrogates are checked against one another and against all entities that occur; what collides, and nothing else, is drawn again. No original
may be a surrogate, so short forms can be full: after every ``SAME_FORM`` draws a value gets one character more, and some draw succeeds.
A frequent entity is counted once before the shuffle; its join is one that adaptive execution splits. Nulls: a null text stays null, null
ids are carried along. Rows with equal ids and texts get the same result. Columns ``n_entities`` and ``surrogates`` of the input are
replaced. Very long texts are treated like others; empty tables give
empty results.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyclock.llm.shared import let, written

#: Titles, by which gender is known, before a name.
_TITLES = r"(?:(?:Mr|Mrs|Ms|Miss|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sr|Sra|Dr|Prof|Professor|Господин|Госпожа|Κύριος|Κυρία)\.?(?: (?:Dr|Prof)\.?)*)"
_EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
_IP = r"(?<![\d.])(?<![vV])(?<!(?i:version|release)[ :]{1,2})(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)"
_CARD = r"(?<![\d+])(?:\d{16}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5}|\d{15})(?!\d)"
_PHONE = r"(?<![\w.])(?:\+\d{1,3}[ .-]?(?:\(\d{2,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?![\w])"
_SECRET = r"""(?i:\b(?:token|password|passwd|secret|api[_-]?key))\s*[=:]\s*["']?[A-Za-z0-9_+/.-]{8,}["']?"""
_IBAN = r"(?<![\w])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)(?![\w])"
_SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
#: Words of three letters and more that are no names though they begin a sentence after a title.
_NO_NAME = r"(?!(?:The|This|That|These|Those|There|Then|Its|She|You|They|And|But|Not|For|From|Are|Was|Who|What|When|Where|Why|How|His|Her|Our|Their|Der|Die|Das|Ein|Eine|Und|Aber|Wir|Sie|Ist|Les|Une|Elle|Nous|Los|Las|Una|Pero)(?!\p{L}))"
_UNCASED = r"(?:\p{IsHan}{2,3}|[\p{IsHebrew}\p{IsArabic}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]{2,})"
_PART = rf"(?:{_UNCASED}|{_NO_NAME}(?:\p{{Lu}}['’]\p{{Lu}}\p{{L}}+|\p{{Lu}}\p{{L}}+)(?:[-'’]\p{{Lu}}\p{{L}}+)*)"
_PARTICLE = r"(?:von|van|der|den|de|del|della|da|di|du|la|le|zu|zur|ter)"
_NAME = rf"(?<!\p{{L}}){_TITLES} {_PART}"
#: All words of a name after a title; each is replaced by itself, there and where it stands without a title in the same text.
_NAMES = rf"(?<!\p{{L}}){_TITLES} (?:{_PARTICLE} )*{_PART}(?: (?:{_PARTICLE} )*{_PART})*"
PATTERN = "|".join((_SECRET, _EMAIL, _IP, _IBAN, _SSN, _CARD, _PHONE, _NAME))
#: Without one of these there is nothing to find; most texts stop here.
_NAMED = rf"{_TITLES} (?:{_PARTICLE} )*(?:\p{{Lu}}|\p{{Lo}})"
_QUICK = rf"[@0-9=:]|{_NAMED}"
_HEX = "0123456789abcdef"
#: draws in a value's own form before it gets a character more
SAME_FORM = 4


def kind_of(entity: Column) -> Column:
    tests = (("secret", _SECRET), ("email", _EMAIL), ("ip", _IP), ("iban", _IBAN), ("ssn", _SSN), ("card", _CARD), ("phone", _PHONE))
    out = F.lit("name")
    for kind, pattern in reversed(tests):
        out = F.when(entity.rlike(f"^(?:{pattern})$"), kind).otherwise(out)
    return out


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def shell(entity: Column, kind: Column) -> Column:
    """What stays in front of the value: a secret's name, a title, a country code."""
    return F.when(kind == "secret", F.regexp_extract(entity, r"""^[^=:]*[=:]\s*["']?""", 0)).when(kind == "name", F.regexp_extract(entity, rf"^{_TITLES} ", 0)).when(kind == "phone", F.regexp_extract(entity, r"^\+\d{1,3}(?=[ .(-])", 0)).otherwise("")


def canonical(value: Column, kind: Column) -> Column:
    return F.when(kind.isin("card", "phone", "ssn"), digits(value)).when(kind == "iban", F.replace(value, F.lit(" "), F.lit(""))).when(kind.isin("email", "name"), F.lower(value)).otherwise(value)


def _stream(key: str, *parts: Column) -> Column:
    """192 hexadecimal digits that depend on the key and all parts."""
    base = F.concat_ws("\x1f", F.lit(key), *parts)
    return F.concat(*(F.sha2(F.concat(base, F.lit(f"\x1f{i}")), 256) for i in range(3)))


def _number(stream: Column, i: Column, most: int) -> Column:
    """The i-th number of the stream, from 0 to most - 1."""
    return F.conv(F.substring(stream, (i * 4) % 188 + 1, F.lit(4)), 16, 10).cast("int") % most


def _pick(alphabet: str, stream: Column, i: Column) -> Column:
    return F.substring(F.lit(alphabet), _number(stream, i, len(alphabet)) + 1, F.lit(1))


_SCRIPTS = (
    ("[0-9]", "0123456789"),
    ("[a-z]", "abcdefghijklmnopqrstuvwxyz"),
    ("[A-Z]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    (r"[\p{IsCyrillic}&&\p{Ll}]", "абвгдежзиклмнопрстуфхцчшэюя"),
    (r"[\p{IsCyrillic}&&\p{Lu}]", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"),
    (r"[\p{IsGreek}&&\p{Ll}]", "αβγδεζηθικλμνξοπρστυφχψω"),
    (r"[\p{IsGreek}&&\p{Lu}]", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"),
    (r"\p{IsHan}", "王李张刘陈杨赵黄周吴徐孙朱马胡郭林何高梁明华丽军平红芳伟强磊"),
    (r"\p{IsHebrew}", "אבגדהוזחטיכלמנסעפצקרשת"),
    (r"\p{IsArabic}", "ابتثجحخدذرزسشصضطظعغفقكلمنهوي"),
    (r"\p{IsHiragana}", "あいうえおかきくけこさしすせそたちつてとなにのはひふほまみむもやゆよらりるれろわ"),
    (r"\p{IsKatakana}", "アイウエオカキクケコサシスセソタチツテトナニノハヒフホマミムモヤユヨラリルレロワ"),
    (r"\p{IsHangul}", "가나다라마바사아자차카타파하"),
    (r"\p{Ll}", "àáâäçèéêëíîïñóôöùúûü"),
    (r"\p{Lu}", "ÀÁÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜ"),
)


def _mapped(value: Column, stream: Column, alphabets=_SCRIPTS) -> Column:
    """Every character turned into one of its own kind."""

    def one(c: Column, i: Column) -> Column:
        out = c
        for pattern, alphabet in reversed(alphabets):
            out = F.when(c.rlike(f"^{pattern}$"), _pick(alphabet, stream, i)).otherwise(out)
        return out

    return F.array_join(F.transform(F.filter(F.split(value, ""), lambda c: c != ""), one), "")


def _luhn(body: Column) -> Column:
    """The digits with the check digit that makes them a card number."""
    places = F.transform(F.reverse(F.filter(F.split(body, ""), lambda c: c != "")), lambda c, i: let(c.cast("int") * F.when(i % 2 == 0, 2).otherwise(1), lambda d: F.when(d > 9, d - 9).otherwise(d)))
    return F.concat(body, ((10 - F.aggregate(places, F.lit(0), lambda a, d: a + d) % 10) % 10).cast("string"))


def _checked(country: Column, account: Column) -> Column:
    """An account number with the two check digits that make it one."""
    every = F.concat(account, country, F.lit("00"))
    value = F.filter(F.split(every, ""), lambda c: c != "")
    left = F.aggregate(value, F.lit(0), lambda a, c: F.when(c.rlike("^[0-9]$"), (a * 10 + F.coalesce(c.try_cast("int"), F.lit(0))) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))
    return F.concat(country, F.lpad((98 - left).cast("string"), 2, "0"), account)


def drawn(kind: Column, value: Column, attempt: Column, key: str, domain: Column | None = None) -> Column:
    """The surrogate of a canonical value; another for every attempt, and one character longer after every ``SAME_FORM`` of them. An
    e-mail address takes the surrogate of its ``domain``."""
    stream = _stream(key, kind, value, attempt.cast("string"))
    more = F.floor(attempt / SAME_FORM).cast("int")
    longer = F.concat(value, F.repeat(F.substring(value, -1, 1), more))
    user = F.concat(F.substring_index(value, "@", 1), F.repeat(F.lit("a"), more))
    host, top = F.regexp_replace(value, r"\.[^.]+$", ""), F.regexp_extract(value, r"\.[^.]+$", 0)
    body = _mapped(F.expr("substring(value, 2, length(value) - 2)"), stream)
    hexadecimal = value.rlike("^[0-9a-f]+$")
    return (
        F.when(kind == "email", F.concat(_mapped(user, stream), F.lit("@"), F.lit("") if domain is None else domain))
        .when(kind == "domain", F.concat(_mapped(F.concat(host, F.repeat(F.lit("a"), more)), stream), top))
        .when(kind == "card", _luhn(F.concat(F.substring(value, 1, 1), body)))
        .when(kind == "iban", _checked(F.substring(value, 1, 2), _mapped(F.expr("substring(value, 5)"), stream)))
        .when(kind == "ip", F.concat_ws(".", *((_number(stream, F.lit(i), 254) + 1).cast("string") for i in range(4))))
        .when((kind == "secret") & hexadecimal, _mapped(longer, stream, ((".", _HEX),)))
        .otherwise(_mapped(longer, stream))
    )


def surrogates(values: DataFrame, key: str) -> DataFrame:
    """``kind``, ``value``, ``surrogate`` of distinct ``kind``, ``value``: all surrogates of a kind distinct, and none an original value."""
    domain = F.substring_index("value", "@", -1)
    hosts = values.where("kind = 'email'").select(F.lit("domain").alias("kind"), domain.alias("value")).distinct()
    named = _settled(hosts.withColumn("domain", F.lit(None).cast("string")), key)
    with_domain = values.join(named.select(F.col("value").alias("d"), F.col("surrogate").alias("domain")), (F.col("kind") == "email") & (domain == F.col("d")), "left")
    return _settled(with_domain.select("kind", "value", "domain"), key)


def _settled(values: DataFrame, key: str) -> DataFrame:
    """Round after round, the values without a surrogate draw one; of those that draw the same one, none that is an original or taken
    already, the least keeps it."""
    values = written(values)
    originals = values.select("kind", F.col("value").alias("surrogate"))
    waiting, done, attempt = values, None, 0
    while True:
        drawing = written(waiting.select("kind", "value", "domain", drawn(F.col("kind"), F.col("value"), F.lit(attempt), key, F.col("domain")).alias("surrogate")))
        free = drawing.join(originals, ["kind", "surrogate"], "left_anti")
        if done is not None:
            free = free.join(done, ["kind", "surrogate"], "left_anti")
        got = written(free.groupBy("kind", "surrogate").agg(F.min("value").alias("value")).select("kind", "value", "surrogate"))
        done = got if done is None else done.unionByName(got)
        waiting = drawing.join(got, ["kind", "value"], "left_anti")
        if not waiting.limit(1).count():
            return done
        attempt += 1


def _pattern(text: Column) -> Column:
    """What is looked for in this text: ``PATTERN``, and the words of its titled names, the longest first; null without such names."""
    none = F.array().cast("array<string>")
    runs = F.regexp_replace(F.array_join(F.regexp_extract_all(text, F.lit(_NAMES), F.lit(0)), "\n"), rf"(?m)^{_TITLES} ", "")
    words = F.filter(F.split(runs, r"[ \n]"), lambda w: w.rlike(r"^[\p{Lu}\p{Lo}]"))
    words = F.array_distinct(F.concat(words, F.transform(words, F.upper)))
    words = F.array_sort(F.when(text.rlike(_NAMED), words).otherwise(none), lambda a, b: F.length(b) - F.length(a))
    # a script without capitals has no spaces between words either
    bounded = F.transform(words, lambda w: F.when(w.rlike(r"^\p{Lo}"), w).otherwise(F.concat(F.lit(r"(?<!\p{L})"), w, F.lit(r"(?!\p{L})"))))
    return F.when(F.size(words) > 0, F.concat(F.lit(PATTERN + "|"), F.array_join(bounded, "|")))


def _found(text: Column, pattern: Column) -> Column:
    every = F.when(pattern.isNull(), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.regexp_extract_all(text, pattern, F.lit(0)))
    return F.when(text.rlike(_QUICK), every).otherwise(F.array().cast("array<string>"))


def _formed(entity: Column, kind: Column, shell_: Column, surrogate: Column) -> Column:
    """The surrogate in the form in which the entity stands in the text."""
    value = F.expr("substring(entity, length(shell) + 1)")
    spread = F.array_join(F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c, i: F.when(c.rlike("^[0-9]$"), F.substring(surrogate, F.length(digits(F.substring(value, F.lit(1), i + 1))), F.lit(1))).otherwise(c)), "")
    spread = F.concat(spread, F.substring(surrogate, F.length(digits(value)) + 1, F.length(surrogate)))
    named = F.array_join(F.transform(F.filter(F.split(surrogate, ""), lambda c: c != ""), lambda c, i: F.when(F.substring(value, i + 1, F.lit(1)).rlike(r"^\p{Lu}$"), F.upper(c)).otherwise(c)), "")
    named = F.when((F.length(value) > 1) & (value == F.upper(value)), F.upper(surrogate)).otherwise(named)
    grouped = F.when(value.contains(" "), F.trim(F.regexp_replace(surrogate, "(.{4})", "$1 "))).otherwise(surrogate)
    cased = F.when(value == F.upper(value), F.upper(surrogate)).otherwise(surrogate)
    quoted = F.concat(surrogate, F.regexp_extract(entity, """["']$""", 0))
    return F.concat(shell_, F.when(kind.isin("card", "phone", "ssn"), spread).when(kind == "iban", grouped).when(kind == "name", named).when(kind == "secret", quoted).when(kind == "email", cased).otherwise(surrogate))


def replaced(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with surrogates in the text, and two columns more: ``n_entities`` and ``surrogates`` (in order of place)."""
    names = {n: f"{n}_{uuid.uuid4().hex}" for n in ("id", "hash", "reps")}
    d, h = F.col(id_col).cast("long"), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    entities = docs.select(d.alias("d"), h.alias("h"), F.posexplode(_found(F.col(text_col), _pattern(F.col(text_col)))).alias("i", "entity"))
    entities = entities.withColumn("kind", kind_of(F.col("entity"))).withColumn("shell", shell(F.col("entity"), F.col("kind")))
    value = F.when(F.col("kind") == "secret", F.regexp_replace(F.expr("substring(entity, length(shell) + 1)"), """["']$""", "")).otherwise(F.expr("substring(entity, length(shell) + 1)"))
    entities = written(entities.withColumn("value", canonical(value, F.col("kind"))))
    table = surrogates(entities.select("kind", "value").distinct(), key)
    formed = entities.join(table, ["kind", "value"]).select("d", "h", "i", _formed(F.col("entity"), F.col("kind"), F.col("shell"), F.col("surrogate")).alias("r"))
    # per document its own entities only; equal rows give equal ones
    lists = formed.groupBy("d", "h").agg(F.sort_array(F.collect_set(F.struct("i", "r"))).alias("x"))
    lists = lists.select(F.col("d").alias(names["id"]), F.col("h").alias(names["hash"]), F.col("x.r").alias(names["reps"]))
    rows = docs.withColumns({names["id"]: d, names["hash"]: h})
    out = rows.join(lists, rows[names["id"]].eqNullSafe(lists[names["id"]]) & (rows[names["hash"]] == lists[names["hash"]]), "left")
    reps = F.coalesce(F.col(names["reps"]), F.array().cast("array<string>"))
    pattern = _pattern(F.col(text_col))
    pieces = F.when(pattern.isNull(), F.split(F.col(text_col), PATTERN)).otherwise(F.split(F.col(text_col), pattern))
    parts = F.zip_with(pieces, reps, lambda p, r: F.concat(p, F.coalesce(r, F.lit(""))))
    text = F.when(F.size(reps) > 0, F.array_join(parts, "")).otherwise(F.col(text_col))
    kept = [text.alias(c) if c == text_col else docs[c] for c in docs.columns if c not in ("n_entities", "surrogates")]
    return out.select(*kept, F.size(reps).cast("long").alias("n_entities"), reps.alias("surrogates"))
