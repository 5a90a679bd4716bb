import datetime as dt
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from spindrift.llm import feistel, formats, pii

GIVEN, FAMILY = {"rosa", "omer", "lucia"}, {"okonweri", "otarrell", "brunnberg"}


def kinds(text, given=GIVEN, family=FAMILY):
    return [(k, text[s:e]) for s, e, k, _ in pii.find(text, given, family)]


@given(st.text("0123456789", max_size=24), st.binary(min_size=1, max_size=8))
def test_feistel_is_a_bijection(digits, key):
    out = feistel.permute_digits(digits, key)
    assert len(out) == len(digits) and feistel.permute_digits(out, key, back=True) == digits


def test_feistel_permutes_all_strings_of_a_length():
    for n in (1, 2, 3):
        all_ = {f"{i:0{n}d}" for i in range(10**n)}
        assert {feistel.permute_digits(s, b"k") for s in all_} == all_


def test_dates_stay_in_their_range():
    days = [dt.date(1900, 1, 1) + dt.timedelta(days=37 * i) for i in range(500)]
    out = [feistel.permute_date(d, b"k") for d in days]
    assert len(set(out)) == len(days) and all(1900 <= d.year <= 2099 for d in out)
    assert [feistel.permute_date(d, b"k", back=True) for d in out] == days
    assert feistel.permute_date(dt.date(1800, 1, 1), b"k") == dt.date(1800, 1, 1)


def test_kinds():
    text = (
        "Write to rosa.ok@mail.example, ivo [at] post [dot] test or x&#64;corp.example. Call +44 20 7946 0505 or (617) 555-0126 ext. 9. "
        "SSN 907-33-6993, DNI 00655471V, NI number QQ 21 96 31 D. She lives at 217 Alder Row, Apt. 3B, Narnanix. Ask Rosa Okonweri or brünnberg, ömer."
    )
    got = kinds(text)
    assert [k for k, _ in got] == ["email"] * 3 + ["phone"] * 2 + ["id_number"] * 3 + ["address"] + ["name"] * 2
    assert ("name", "Rosa Okonweri") in got and ("address", "217 Alder Row, Apt. 3B, Narnanix") in got


def test_no_kinds():
    for text in (
        "(chart9@2x.png) (fs_read@v1) (price@close 78.43) parser@2.13.0", "(lot 254-121-890) (part 555-0440-AX) (accession 0003341860-24-260707) (build 3.36.2.87)", "(7 243 104 409 shares), US$148.0 million in fiscal 2022",
        "(Okonweri & Brünnberg LLP) (the Okonweri valve) (Okonweri Holdings plc)", "(29 street-level outlets) (the Alder Row programme)", "we met at noon", "", "DNI-like 00655471X",
    ):
        assert kinds(text) == [], text


def test_placeholders_keep_the_rest_and_link_equal_values():
    text = "Dr. Okonweri: +1-617-555-0147, again +1-617-555-0147; id 00655471V."
    found = pii.find(text, GIVEN, FAMILY)
    out = pii.masked(text, found, b"key")
    parts = [p.split("]", 1)[-1] for p in out.split("[")]
    assert "".join(parts) == ": , again ; id ."
    assert out.count(out.split("[PHONE:")[1].split("]")[0]) == 2
    number = out.split("[ID_NUMBER:")[1].split("]")[0]
    assert number != "00655471V" and formats.dni_letter(number[:8]) == number[-1]
    assert pii.masked(text, found, b"other") != out


def frame(spark, rows):
    return spark.createDataFrame(rows, "origin string, rec_id long, text string, mentions string, kind string")


RECORDS = [
    ("raw", 1, "Prepared by Lucía Okonweri. Mail lucia.okonweri@mail.example", "old", "x"), ("raw", 2, "cc: lucia.okonweri@post.test. Signed, Lucía Okonweri", None, "x"),
    ("query", 1, "thanks, lucía okonweri", None, None), ("query", 2, None, None, None), ("query", 3, "", None, None), ("query", 3, "", None, None), ("query", 4, "plain " * 20000, None, None),
]


def test_operators_with_nulls_repeats_and_clashing_columns(spark, as_rows):
    df = frame(spark, RECORDS)
    want = [("query", 1, "name"), ("raw", 1, "email"), ("raw", 1, "name"), ("raw", 2, "email"), ("raw", 2, "name")]
    assert as_rows(pii.mentions(df), "origin", "rec_id", "kind") == want
    assert as_rows(pii.mentions(df, broadcast_names=0), "origin", "rec_id", "kind") == want  # the joined lexicon
    out = pii.redacted(df, b"key")
    assert sorted(out.columns) == sorted([*df.columns, "kinds"]) and out.count() == len(RECORDS)
    assert as_rows(pii.redacted(df, b"key", broadcast_names=0).drop("mentions")) == as_rows(out.drop("mentions"))
    with pytest.raises(ValueError):
        pii.redacted(df, b"")
    got = {(r.origin, r.rec_id): r for r in out.collect()}
    assert got["query", 2].text is None and got["query", 3].text == "" and got["query", 4].text == "plain " * 20000
    assert got["query", 1].text.startswith("thanks, [NAME:") and got["query", 1].mentions == 1 and got["raw", 1].kind == "x"


def test_empty_table(spark):
    assert pii.mentions(frame(spark, [])).count() == 0 and pii.redacted(frame(spark, []), b"key").count() == 0


def test_anchors_without_the_automaton(monkeypatch):
    import sys

    text = RECORDS[0][2] + " Tel. 020 7946 0263, 12 Alder Row"
    fast = kinds(text)
    monkeypatch.setitem(sys.modules, "ahocorasick", None)
    monkeypatch.setattr(pii, "_iter_anchors", None)
    assert kinds(text) == fast
    monkeypatch.setattr(pii, "_iter_anchors", None)


def test_names_of_one_record_and_short_names(spark, as_rows):
    rows = [
        ("raw", 1, "My name is Ada Quill. I wrote twice; Quill, Ada is on the list."), ("raw", 2, "Ask Tova Merrin or write to tova.merrin@mail.example"), ("raw", 3, "Investor Relations: investor.relations@mail.example"),
        ("raw", 4, "Mein Name ist Jun Li."), ("raw", 5, "Prepared by Jun Li"), ("raw", 6, "We met Jun Li there"), ("raw", 7, "a list of jun li and others"),
    ]
    df = spark.createDataFrame(rows, "origin string, rec_id long, text string")
    want = [("raw", 1, "name"), ("raw", 2, "email"), ("raw", 2, "name"), ("raw", 3, "email"), ("raw", 4, "name"), ("raw", 5, "name"), ("raw", 6, "name")]
    assert as_rows(pii.mentions(df), "origin", "rec_id", "kind") == want
    assert as_rows(pii.mentions(df, broadcast_names=0), "origin", "rec_id", "kind") == want
    assert [(r.mentions, r.kinds) for r in pii.redacted(df.filter("rec_id = 1"), b"key").collect()] == [(2, ["name"])]


def test_long_mentions_are_whole(spark):
    host = ".".join(["h" * 60] * 4) + ".example"
    street = "12 " + "Langbuchenholzhausen" * 6 + " Alder Street, " + "Narnanix"
    for text, want in ((f"write to {'a' * 200}@{host} now", f"{'a' * 200}@{host}"), (f"at {street} today", street)):
        found = pii.find(text, GIVEN, FAMILY)
        assert [text[s:e] for s, e, _, _ in found] == [want]
        assert found == pii.find(text, GIVEN, FAMILY, windows=False)


PARTS = ["Rosa Okonweri", "rosa.ok@mail.example", "ivo [at] post [dot] test", "+44 20 7946 0505", "(617) 555-0126 ext. 9", "907-33-6993", "00655471V", "QQ 21 96 31 D", "217 Alder Row, Apt. 3B, Narnanix", "12 bis rue de la Paix, 75002 Paris", "Calle de la Luna Alta 14", "Am Alten Markt 3", "Passport no. X1234567", "my name is", "Dr. Brünnberg", "Tel.: 030 12345678", "word", "and the", "street", "at", "2.5%", ",", "\n", "(lot 254-121-890)", "Prof. Dr. med.", "codice fiscale", "RSSMRA85T10A562S"]


@given(st.lists(st.sampled_from(PARTS), max_size=14), st.sampled_from([" ", "  ", "\n", ", "]))
def test_windows_lose_nothing(parts, gap):
    text = gap.join(parts)
    assert pii.find(text, GIVEN, FAMILY) == pii.find(text, GIVEN, FAMILY, windows=False)


def test_names_shown_by_their_own_record():
    for text, want in (("My name is Zebulon Quarkwright.", "Zebulon Quarkwright"), ("Ask Mr Žižek", "Mr Žižek"), ("Frau Şahin kam", "Frau Şahin")):
        assert ("name", want) in kinds(text, set(), set()), text


def pseudo(value, form):
    return formats.pseudo_id(value, form, b"key")


def test_identity_numbers_stay_valid_and_hide_their_letters():
    nir = "1850575116001"
    cases = {"nir": f"1 85 05 75 116 001 {formats.nir_key(nir)}", "cf": "RSSMRA85T10A562" + formats.cf_letter("RSSMRA85T10A562"), "nino": "AB 12 34 56 C", "dni": "00655471" + formats.dni_letter("00655471"), "nie": "X1234567" + formats.dni_letter("01234567"), "ssn": "907-33-6993"}
    assert cases["cf"] == "RSSMRA85T10A562S"
    for form, value in cases.items():
        new = pseudo(value, form)
        assert new != value and [c.isalnum() for c in new] == [c.isalnum() for c in value] and formats.core(new)[:3] != formats.core(value)[:3], form
        assert pseudo(value, "cued" if form != "ssn" else "ssn") == new and pseudo(new, form) != new
        c = formats.core(new)
        assert {"nir": lambda: c[13:] == formats.nir_key(c[:13]) and "01" <= c[3:5] <= "12", "cf": lambda: c[15] == formats.cf_letter(c[:15]) and c[8] in "ABCDEHLMPRST", "nino": lambda: c[:2].isalpha() and c[8] in "ABCD", "dni": lambda: c[8] == formats.dni_letter(c[:8]), "nie": lambda: c[8] == formats.dni_letter(f"{'XYZ'.index(c[0])}{c[1:8]}"), "ssn": lambda: formats.valid_ssn(c)}[form](), (form, new)
    for body, check in (("8609574271", formats.steuer_digit), ("111444777", formats.cpf_digits), ("50144202", formats.nif_digit), ("11122233", formats.bsn_digit)):
        new = pseudo(body + check(body), "cued")
        assert new[len(body) :] == check(new[: len(body)]) and new[: len(body)] != body
    assert formats.steuer_digit("8609574271") == "9" and formats.cpf_digits("111444777") == "35" and formats.bsn_digit("11122233") == "3"
    assert not {"X", "1"} & set(pseudo("X1111111", "plain")[:1]) and pseudo("", "cued") == ""


def test_permutations_are_bijections():
    rnd = random.Random(5)
    for form, make in (("nino", lambda: "AB" + f"{rnd.randrange(10**6):06d}" + "C"), ("dni", lambda: (d := f"{rnd.randrange(10**8):08d}") + formats.dni_letter(d)), ("ssn", lambda: f"1{rnd.randrange(10**2):02d}{rnd.randrange(1, 99):02d}{rnd.randrange(1, 9999):04d}")):
        values = {make() for _ in range(400)}
        assert len({pseudo(v, form) for v in values}) == len(values)
    for word, alphabet in (("", "AB"), ("A", "ABC"), ("ZEBRA", feistel.LETTERS)):
        assert feistel.permute_word(feistel.permute_word(word, alphabet, b"k"), alphabet, b"k", back=True) == word


def test_equal_values_are_linked_however_written():
    phone = lambda v: formats.pseudo_phone(v, b"key")
    assert len({phone(v) for v in ("+49 30 12345678", "0049 30 12345678", "+49 (0)30 12345678", "+493012345678")}) == 1
    assert len({phone(v) for v in ("(415) 555-0132", "+1 415 555 0132", "1-415-555-0132", "415.555.0132")}) == 1
    assert phone("+49 30 12345678") != phone("+49 30 12345679") and phone("030 12345678").startswith("0") and phone("+49 30 12345678").startswith("+49 ")
    same = lambda k, *vs: len({pii.pseudonym(v, k, "", b"key") for v in vs}) == 1
    assert same("email", "ivo [at] post [dot] test", "Ivo@post.test", "ivo&#64;post.test") and same("name", "Rosa Okonweri", "OKONWERI, Rosa") and same("name", "Dr. Brünnberg", "Frau Brünnberg")
    assert same("birth_date", "1970-01-31") and pii.pseudonym("1970-01-31", "birth_date", "", b"key") != "[BIRTH_DATE:1970-01-31]"


def test_bank_accounts_are_no_phones():
    assert kinds("IBAN DE89 3704 0044 0532 0130 00 or GB82 WEST 1234 5698 7654 32") == []


def test_key_of_the_session(spark):
    assert pii.session_key(spark) != pii.session_key(spark)
    spark.conf.set("spindrift.pii.key", "secret")
    try:
        assert pii.session_key(spark) == b"secret"
    finally:
        spark.conf.unset("spindrift.pii.key")
