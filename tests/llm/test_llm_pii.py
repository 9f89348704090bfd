"""Detection of personal data, placeholders and surrogates."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tamarisk.llm import pii, surrogates

KNOWN = frozenset("drahu tekourum medrox vatai gisox noustaimbir kothgri hácouth foulboun".split())


def found(text):
    return [(s.kind, text[s.start : s.end]) for s in pii.find_spans(text, KNOWN)]


CASES = {
    "see a.b+c@x-y.example.com.": [("email", "a.b+c@x-y.example.com")], "mailto:a_1@b.test; (c&#64;d.org)": [("email", "a_1@b.test"), ("email", "c&#64;d.org")], "write to j AT fugou DOT example DOT org now": [("email", "j AT fugou DOT example DOT org")],
    "to x (at) lufe (dot) example": [("email", "x (at) lufe (dot) example")], "a[at]b.test": [("email", "a[at]b.test")], "p @ q.example.com": [("email", "p @ q.example.com")], "cat@home and dog@work, tables@1.3.5, build@node64:~$, meet at 5 dot": [],
    "call +1 (473) 555-0101 or (595) 555 0162": [("phone", "+1 (473) 555-0101"), ("phone", "(595) 555 0162")], "tel:+17715550195.": [("phone", "+17715550195")], "my mobile is 020 7946 0819, or 07700-900-523": [("phone", "020 7946 0819"), ("phone", "07700-900-523")],
    "text +1-454-555-0145 ext. 829 or": [("phone", "+1-454-555-0145 ext. 829")], "call ＋１－５３７－５５５－０１００ after": [("phone", "＋１－５３７－５５５－０１００")], "call back 5785550122.": [("phone", "5785550122")], "questions: a AT b DOT test / 5785550122\n": [("email", "a AT b DOT test"), ("phone", "5785550122")], "order 5785550122, build 657444155, artefact 5712027530": [],
    "auprès de M. Daibro, 01 99 00 37 75.": [("name", "Daibro"), ("phone", "01 99 00 37 75")], "peer 198.51.100.112, 2021-08-11 17:15, 5.16.10.75, scores 81-38, code 97-8146-11-72, invoice 20-1970-85, ticket 2324-87": [],
    "SSN 951059099 / x": [("id_number", "951059099")], "number 925-26-7590": [("id_number", "925-26-7590")], "insurance QQ 85 92 81 C, letter": [("id_number", "QQ 85 92 81 C")], "id 90-33028362-5;": [("id_number", "90-33028362-5")], "DNI 97.823.277-K": [("id_number", "97.823.277-K")], "DNI 99935092.": [("id_number", "99935092")],
    "passport XQ4715589.": [("id_number", "XQ4715589")], "Паспорт 9920 402408, телефон": [("id_number", "9920 402408")], "ref zu56509567, commit 08708122": [],
    "lives at 62 Braipou Blvd, Bobrea, tel x": [("address", "62 Braipou Blvd, Bobrea")], "at 188-190 Old Revistour St., Apt 43, Stexbru 00015, ring": [("address", "188-190 Old Revistour St., Apt 43, Stexbru 00015")], "en Pje. Lourboustar 185, 05898 Dreakearo. Según": [("address", "Pje. Lourboustar 185, 05898 Dreakearo")],
    "a Avenida Predugex N.º 229, Mearum": [("address", "Avenida Predugex N.º 229, Mearum")], "au 285, rue des Stouhas.": [("address", "285, rue des Stouhas")], "Адрес: ул. Raigream, д. 9, кв. 27. До": [("address", "ул. Raigream, д. 9, кв. 27")], "237 predugex court\nbp": [("address", "237 predugex court")],
    "27 street stalls, 42 Road trips, 90 Avenue cafés, see Plaza 3 de Abril, the plaza from 1893": [],
    "approved by Drahu Tekourum\n": [("name", "Drahu Tekourum")], "approved by Bufon Saibrigror\n": [("name", "Bufon Saibrigror")], "back to Medrox, Drahu, 12": [("name", "Medrox, Drahu")], "Ask for Ms Prebul at": [("name", "Prebul")], "DRAHU TEKOURUM / SSN 996095506": [("name", "DRAHU TEKOURUM"), ("id_number", "996095506")],
    "guide drahu medrox meets": [("name", "drahu medrox")], "pt G. Medrox, id": [("name", "G. Medrox")], "photo by Drahu A. Vatai-Medrox, all": [("name", "Drahu A. Vatai-Medrox")], "Dra.&nbsp; Kothgri espera": [("name", "Kothgri")],
    "Medrox Ridge, Lake Kothgri, der Medrox-See, Cerro Vatai, la Plaza 3 de Abril de Medrox, the Noustaimbir Museum, @medrox_5, Cepusti Draihizun": [], "we asked Drahu Medrox and Dr. Hipri, neither": [("name", "Drahu Medrox"), ("name", "Hipri")],
}


@pytest.mark.parametrize("text", CASES)
def test_spans(text):
    assert found(text) == CASES[text]


def test_null_empty_and_long_texts():
    assert pii.find_spans(None, KNOWN) == pii.find_spans("", KNOWN) == []
    long = "word 12 " * 50_000 + "call +17715550195"
    assert [s.kind for s in pii.find_spans(long, KNOWN)] == ["phone"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "Mail drahu@x.test, call +1 (473) 555-0101."), (2, "approved by Drahu Medrox and Mr Medrox; ☕ DRAHU MEDROX"), (3, "approved by Drahu Medrox and Mr Medrox; ☕ DRAHU MEDROX"), (4, None), (5, ""), (6, "nothing"), (6, "nothing"), (None, "SSN 951059099")]
    return spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("doc_id", "text", "1 AS kind", "2 AS row")


@pytest.fixture(scope="module")
def names(spark):
    return spark.createDataFrame([("Drahu", "given"), ("Medrox", "family"), (None, None)], "name string, kind string")


def test_entities_and_placeholders(docs, names):
    e = {(r.doc_id, r.kind, r.start_char) for r in surrogates.find_entities(docs, names, "k").collect()}
    assert e == {(1, "email", 6), (1, "phone", 25), (None, "id_number", 5)} | {(d, "name", s) for d in (2, 3) for s in (13, 33, 43)}
    t = {r.doc_id: r.text for r in surrogates.replace_entities(docs, names, "k", by="placeholder").collect()}
    assert t[1] == "Mail [EMAIL], call [PHONE]." and t[2] == "approved by [NAME] and Mr [NAME]; ☕ [NAME]" and t[4] is None and t[5] == ""


def test_surrogates(docs, names):
    out = surrogates.replace_entities(docs, names, "secret").collect()
    t = {r.doc_id: r.text for r in out}
    assert len(out) == docs.count() and t[2] == t[3] and t[4] is None and t[5] == "" and t[6] == "nothing"
    given, family = t[2][len("approved by ") :].split(" ")[:2]
    assert "Drahu" not in t[2] and given[0].isupper() and t[2].endswith(f"☕ {given.upper()} {family.upper()}") and f"Mr {family};" in t[2]
    assert t[1].startswith("Mail ") and "@x.test" not in t[1] and len(t[1]) == len("Mail drahu@x.test, call +1 (473) 555-0101.")
    assert t[None][:4] == "SSN " and t[None][4:].isdigit() and t[None] != "SSN 951059099"
    again = {r.doc_id: r.text for r in surrogates.replace_entities(docs, names, "secret").collect()}
    other = {r.doc_id: r.text for r in surrogates.replace_entities(docs, names, "another").collect()}
    assert again == t and other[2] != t[2]
    checks = surrogates.check_replaced(docs, names, "secret").collect()
    assert len(checks) == docs.count() and all(r.untouched and r.changed for r in checks)
    distinct = surrogates.check_distinct(surrogates.find_entities(docs, names, "secret")).collect()
    assert {r.kind for r in distinct} == {"email", "phone", "id_number", "name"} and all(r.apart and r.together for r in distinct)


def test_checks_see_faults():
    es = surrogates.entities("a Drahu Medrox b", KNOWN, "k")
    assert surrogates.untouched("a Drahu Medrox b", es, surrogates.rewritten("a Drahu Medrox b", es, "surrogate"), "surrogate")
    assert not surrogates.untouched("a Drahu Medrox b", es, "a Xxxxx Yyyyyy c", "surrogate") and not surrogates.untouched("a Drahu Medrox b", es, "c Xxxxx Yyyyyy b", "surrogate")


UNITS = {
    "digits of one length": [f"{i:03d}" for i in range(1000)], "one digit": list("0123456789"), "Latin letters": [a + b for a in "abcdefghijklmnopqrstuvwxyz" for b in "bcdfghiu"], "initials": list("abcdefghijklmnopqrstuvwxyz"), "Greek": [a + b + "ς" for a in "αβγδεζηθικλμνξοπρστυφχψω" for b in "αβγδεώή"],
    "Cyrillic": [a + b for a in "абвгдежзийклмнопрстуфхцчшщъыьэюя" for b in "абвг"], "Arabic": [a + b for a in "ابتثجحخدذرزسشصضطظعغفقكلمنهوي" for b in "ابتي"], "Hebrew": [a + b for a in "אבגדהוזחטיכלמנסעפצקרשת" for b in "אבג"], "Hangul": list("김이박최정강조윤장임"), "Georgian": list("აბგდევზთიკლმნოპ"),
    "Devanagari": list("कखगघचछजझटठडढतथदधनपफबभमयरलव"), "kanji": list("山田中佐藤鈴木高橋伊"), "Arabic digits": list("٠١٢٣٤٥٦٧٨٩"), "marked Latin": ["é", "ñ", "ø", "ł", "ş", "ž", "ő"], "mixed": ["d2", "2d", "é1", "e1", "a", "aa", "ab", "ba"],
}


@pytest.mark.parametrize("what", UNITS)
def test_units_stay_apart_and_none_stays_as_written(what):
    for key in map(str, range(40)):
        drawn = [surrogates.draw(key, u) for u in UNITS[what]]
        assert len(set(drawn)) == len(set(UNITS[what])) and all(d != u and len(d) == len(u) for d, u in zip(drawn, UNITS[what]))


def test_texts_of_any_script_are_replaced():
    text = "mail δοκιμή@παράδειγμα.gr, Иван@пример.рф, اختبار@مثال.إختبار or 测试@例子.测试, sign by Drahu Medrox and Mr Medrox"
    es = surrogates.entities(text, KNOWN, "k")
    assert [e.kind for e in es] == ["email"] * 4 + ["name"] * 2
    new = surrogates.rewritten(text, es, "surrogate")
    assert not any(w in new for w in ("δοκιμή", "παράδειγμα", "Иван", "пример", "اختبار", "مثال", "测试", "例子", "Drahu", "Medrox")) and new.count("@") == 4


@settings(max_examples=300, deadline=None)
@given(st.text(min_size=1, max_size=12), st.text(min_size=1, max_size=12))
def test_any_two_units_stay_apart(a, b):
    a, b = surrogates._fold(a), surrogates._fold(b)
    if any(c.isalnum() for c in a):
        assert surrogates.draw("k", a) != a
    if a != b and any(c.isalnum() for c in a) and any(c.isalnum() for c in b):
        assert surrogates.draw("k", a) != surrogates.draw("k", b)


def test_endings_and_coreference():
    assert all(surrogates.draw("k", n)[-1] == n[-1] for n in ("maria", "pedro", "irene")) and surrogates.draw("k", "li")[-1] in "iu"
    one, two = (surrogates.entities(t, KNOWN, "k")[0].surrogate for t in ("at 12 Braipou Street, ring", "at 13 Braipou Street, Flat 2, ring"))
    assert one.split()[1:] == two.rstrip(".").split(",")[0].split()[1:] and one.split()[0] != two.split()[0] and one.endswith("Street")


def test_extension_is_replaced():
    entity = "+1-454-555-0145 ext. 829"
    units = surrogates.units_of("phone", entity)
    assert [entity[u.start : u.end] for u in units] == ["1-454-555-0145", "829"] and [u.text for u in units] == ["14545550145", "829"]
    assert [u.text for u in surrogates.units_of("phone", entity[:15])] == ["14545550145"]
    made = surrogates.entities(f"call {entity} now", KNOWN, "k")[0].surrogate
    assert made[:15] == surrogates.entities(f"call {entity[:15]} now", KNOWN, "k")[0].surrogate and made[15:21] == " ext. " and made[21:] != "829"


def test_empty(docs, names):
    e = docs.limit(0)
    assert surrogates.find_entities(e, names, "k").count() == surrogates.replace_entities(e, names, "k").count() == surrogates.check_replaced(e, names, "k").count() == surrogates.check_distinct(surrogates.find_entities(e, names, "k")).count() == 0
