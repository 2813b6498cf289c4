"""Personal data beside other numbers is found."""

import random

import pytest
from pyspark.sql import functions as F

from lexfold.llm import pii
from tests.llm import data

CARD = "4111 1111 1111 1111"


@pytest.mark.parametrize("text", ["%s 12/27", "4111-1111-1111-1111 123", "no 7 %s", "2 4111111111111111", "12345-4111-1111-1111-1111", "4111-1111-1111-1111-12345", "%s 5500 0000 0000 0004", "1 2 3 4 5 6 %s 7", "%s 123-45-6789", "%s 2024-01-02", "%s 12.03.2024"])
def test_cards_beside_other_numbers_are_found(text):
    text = text.replace("%s", CARD)
    new, spans = pii.rewrite(text, pii.Feistel(b"key").permute)
    cards = [v.replace(" ", "").replace("-", "") for k, _, _, v in spans if k == "card"]
    assert any("4111111111111111" in c for c in cards) and len(new) == len(text)
    assert all(new[s:e] != v and text[s:e] == v for _, s, e, v in spans)
    kinds = {k for k, *_ in spans}
    assert ("ssn" in kinds) == ("6789" in text) and ("iso" in kinds) == ("-01-02" in text) and ("dmy" in kinds) == (".03." in text)
    assert "5500" not in text or len(cards) == 2


def test_dates_before_a_time_are_found():
    spans = pii.rewrite("2024-01-02T10:00 and 2024-01-02Tea", pii.Feistel(b"key").permute)[1]
    assert spans == [("iso", 0, 10, "2024-01-02")]


def test_a_day_is_linked_in_all_formats():
    step = pii.Feistel(b"key").permute
    seen = set()
    for day in range(1, 32):
        iso, dmy, us = f"2024-01-{day:02d}", f"{day:02d}.01.2024", f"01/{day:02d}/2024"
        y, m, d = pii.rewrite(iso, step)[0].split("-")
        assert pii.rewrite(dmy, step)[0] == f"{d}.{m}.{y}" and (int(d) > 12) == (day > 12)
        if day > 12:  # can only be read month first
            assert pii.rewrite(us, step)[0] == f"{m}/{d}/{y}"
        seen.add((y, m, d))
        assert pii.rewrite("-".join((y, m, d)), pii.Feistel(b"key").invert)[0] == iso
    assert len(seen) == 31


def test_query_finds_planted_values_and_keeps_the_rest(spark, tmp_path):
    values = {"card": CARD, "iban": "DE89370400440532013000", "ip": "10.20.30.40", "iso": "2024-02-29", "ssn": "123-45-6789", "email": "some.one@example.com"}
    r = random.Random(2)
    rows, want = [], {}
    for i in range(60):
        words = [r.choice(["plain", "words", "of", "a", "text", "12", "2024"]) for _ in range(25)]
        planted = r.sample(sorted(values), r.randint(0, 3))
        for k in planted:
            words.insert(r.randrange(len(words)), "see " + values[k] + ",")
        text = " ".join(words)
        rows.append((i, text, "en", "s", 0))
        want[i] = sorted((text.find(values[k]), k, values[k]) for k in planted)
    data.frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.conf.set(pii.KEY_SETTING, "a key of the session")
    try:
        got = pii.op7_pii(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset(pii.KEY_SETTING)
    assert [f.dataType.simpleString() for f in spark.read.parquet(str(tmp_path / "documents.parquet")).schema][:2] == ["bigint", "string"]
    linked = {}
    for g in got:
        text = rows[g["doc_id"]][1]
        assert g["n_found"] == len(want[g["doc_id"]]) and g["spans"] == ",".join(f"{k}:{a}:{a + len(v)}" for a, k, v in want[g["doc_id"]])
        at = 0
        for a, _, v in want[g["doc_id"]]:
            assert g["text"][at:a] == text[at:a] and g["text"][a : a + len(v)] != v
            assert linked.setdefault(v, g["text"][a : a + len(v)]) == g["text"][a : a + len(v)]
            at = a + len(v)
        assert g["text"][at:] == text[at:]
    assert linked["123-45-6789"] != pii.rewrite("123-45-6789", pii.Feistel(pii.DEMO_KEY).permute)[0]


def test_clashing_names_nulls_and_long_texts(spark):
    df = data.odd(spark).withColumns({"pii_spans": F.lit("mine"), "a.b": F.lit(1)})
    out = pii.pseudonymise(df)
    assert out.columns == [*df.columns, "pii_spans_"] and out.drop("pii_spans_").exceptAll(df).count() == 0


PLANTED = [
    ("card", "2223 0031 2200 3222"),
    ("email", "j\u00f6rg.m\u00fcller@firma.de"),
    ("email", "jo\u0308rg@b\u00fccher.example"),
    ("email", "_\u0438\u0432\u0430\u043d@\u043f\u043e\u0447\u0442\u0430.\u0440\u0444"),
    ("email", "o'brien@mail.example.com"),
    ("email", "a1@a.b.c.d.e.f.g.h.i.j.example.org"),
    ("email", "x" * 80 + "9@example.org"),
    ("iban", "de89370400440532013000"),
    ("iban", "at61 1904 3002 3457 3201"),
    ("iso", "1815-06-18"),
    ("iso", "2024-1-2"),
    ("dmy", "3.4.1999"),
    ("dmy", "12/1/1789"),
    ("phone", "0049 30 1234567"),
    ("phone", "+49 30 1234567"),
]


@pytest.mark.parametrize("kind,value", PLANTED)
def test_values_of_every_form_are_replaced_whole_and_come_back(kind, value):
    f = pii.Feistel(b"key")
    text = f"see {value} the rest"
    new, spans = pii.rewrite(text, f.permute)
    assert spans == [(kind, 4, 4 + len(value), value)]
    assert len(new) == len(text) and new[:4] == text[:4] and new[4 + len(value) :] == text[4 + len(value) :] and new != text
    assert pii.rewrite(new, f.invert)[0] == text
    assert pii.rewrite(new, f.permute)[1][0][:3] == spans[0][:3]  # valid itself


def test_formats_of_one_value_stay_linked():
    step = pii.Feistel(b"key").permute
    y, m, d = pii.rewrite("1999-04-03", step)[0].split("-")
    assert pii.rewrite("3.4.1999", step)[0] == f"{int(d)}.{int(m)}.{y}" and pii.rewrite("1999-4-3", step)[0] == f"{y}-{int(m)}-{int(d)}"
    assert pii.rewrite("0049 30 1234567", step)[0][4:] == pii.rewrite("+49 30 1234567", step)[0][3:]


@pytest.mark.parametrize("text", ["2024-13-02 and 1.2.4096 and 0.1.2000", "2721 0000 0000 0008", "...@example.org", "a'" * 50_000, "a." * 50_000 + "@", "word-" * 40_000])
def test_what_is_none_of_these_stays(text):
    assert pii.rewrite(text, pii.Feistel(b"key").permute) == (text, [])
