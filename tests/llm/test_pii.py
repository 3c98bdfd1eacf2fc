from __future__ import annotations

import pytest

from reportloom.llm import pii

CASES = [
    ("Please reply to ann+b@post.kite.example.", [("email", "ann+b@post.kite.example")]),
    ("mailto:ANN_X@RELAY.EXAMPLE", [("email", "ANN_X@RELAY.EXAMPLE")]),
    ("to <ann.b (at) post (dot) kite (dot) example>, thanks", [("email", "ann.b (at) post (dot) kite (dot) example")]),
    ("E-mail: ann [at] kite.example", [("email", "ann [at] kite.example")]),
    ("contact: ann @ kite.example", [("email", "ann @ kite.example")]),
    ("Clone of ssh://build@ci.gantry.invalid:22/x.git stops.", []),
    ("Package @ab/cd@3.5.2 is pinned. Thanks @ann_1", []),
    ("Call me on +44 1632 960674 if the log", [("phone", "+44 1632 960674")]),
    ("in this viewport. Call me on (212) 555-0198 if", [("phone", "(212) 555-0198")]),
    ("Tel. 020 7946 0333", [("phone", "020 7946 0333")]),
    ("Frames 035 9279 0703 differ, code 907-1565 is new.", []),
    ("Copied 42 840 232 986 bytes before the stall.", []),
    ("The form stores the tax ID 82 257 186 745 unmasked.", [("identity_number", "82 257 186 745")]),
    ("N° d'identité 928 37 5505", [("identity_number", "928 37 5505")]),
    ("Ausweis-Nr. QQ 38 42 31 A", [("identity_number", "QQ 38 42 31 A")]),
    ("residence ID: X-4988112-R", [("identity_number", "X-4988112-R")]),
    ("paid from DE89 3704 0044 0532 0130 00 today", [("identity_number", "DE89 3704 0044 0532 0130 00")]),
    ("paid from DE88 3704 0044 0532 0130 00 today", []),
    ("Billing address: 318B Larch Rd, Dunscarth", [("street_address", "318B Larch Rd")]),
    ("GPS: 57, rue des Sorbiers, Velmont", [("street_address", "57, rue des Sorbiers")]),
    ("GPS: Kastanienbrunner Straße 206, Dunscarth", [("street_address", "Kastanienbrunner Straße 206")]),
    ("GPS: Avenida Encinar 335, Aldport", [("street_address", "Avenida Encinar 335")]),
    ("It mounts 28 Backup Lane volumes and lists 2 Avenue tiles.", []),
    ("Ms. Tobias J. Fennaldsen asked us to escalate.", [("person_name", "Tobias J. Fennaldsen")]),
    ("Regards,\nEmeka Merwick-Korström\n\nNext Line", [("person_name", "Emeka Merwick-Korström")]),
    ("As Korovic, Malik wrote last week", [("person_name", "Korovic, Malik")]),
    ("-- ISIDRO THARUCHI", [("person_name", "ISIDRO THARUCHI")]),
    ("Thanks to Night Queue for the trace. cc: Release Robot", []),
    ("Thanks to Fabian for the trace.", []),
    ("As noted, it is not fixed.", []),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_found(text, want):
    assert [(s.kind, text[s.start : s.end]) for s in pii.spans(text)] == want


def test_checks():
    assert pii.luhn("4539578763621486") and not pii.luhn("4539578763621487")
    assert pii.mod97("GB82 WEST 1234 5698 7654 32") and not pii.mod97("GB82 WEST 1234 5698 7654 33")


def test_tables(spark):
    rows = [(1, "Call me on +44 1632 960674, Ann"), (2, None), (3, ""), (4, "x " * 200000 + "mailto:a@b.example"), (1, "Call me on +44 1632 960674, Ann")]
    df = spark.createDataFrame([(*r, "k", "f") for r in rows], "doc_id long, text string, kind string, found_text string")
    got = sorted((r.doc_id, r.kind, r.found_text) for r in pii.find(df).collect())
    assert got == [(1, "phone", "+44 1632 960674")] * 2 + [(4, "email", "a@b.example")]
    out = {r.doc_id: (r.text, r.replaced) for r in pii.redacted(df).collect()}
    assert out[1] == ("Call me on [PHONE], Ann", 1) and out[2] == (None, 0) and out[3] == ("", 0)
    assert out[4][0].endswith("mailto:[EMAIL]")
    assert pii.find(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("I spoke with Anna Schmidt yesterday.", [("person_name", "Anna Schmidt")]),
        ("It was Laura Jensen, not the cron job.", [("person_name", "Laura Jensen")]),
        ("Our colleague Oyelaran Bakari can repeat it.", [("person_name", "Oyelaran Bakari")]),
        ("As K. Quanovic wrote last week", [("person_name", "K. Quanovic")]),
        ("Later Oyelaran Bakari replied that it works.", [("person_name", "Oyelaran Bakari")]),
        ("I spoke with Night Queue. The Main Menu says Visual Home.", []),
        ("Open the Print Preview window, then Pressing Ctrl fails.", []),
        ("The old sheet had 212.555.0146 in it.", [("phone", "212.555.0146")]),
        ("Use 020 7946 0333 after lunch", [("phone", "020 7946 0333")]),
        ("Read 42 840 232 9860 rows, frames 035 9279 0703 differ.", []),
    ],
)
def test_personal_information_in_other_wordings(text, want):
    assert [(s.kind, text[s.start : s.end]) for s in pii.spans(text)] == want


@pytest.mark.parametrize(
    ("label", "number", "want"),
    [("PESEL", "44051401359", True), ("PESEL", "44051401358", False), ("CPF", "529.982.247-25", True), ("CPF", "529.982.247-24", False), ("DNI", "12345678Z", True),
     ("NIF", "12345678A", False), ("BSN", "111222333", True), ("Steuer-ID", "86 095 742 719", True), ("Steuer-ID", "86 095 742 718", False), ("passport", "X1234567", None)],
)
def test_checksums_by_label(label, number, want):
    assert pii.checksum(label, number) is want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Спасибо, Ирина Соколова", [("person_name", "Ирина Соколова")]), ("Reported by Şule Čapková.", [("person_name", "Şule Čapková")]),
        ("昨日、山田太郎さんが確認しました。", [("person_name", "山田太郎")]), ("ご担当者様", []), ("김민수 씨가 확인했습니다.", [("person_name", "김민수")]),
        ("ftp://ann:pw@host.example/x", []), ("My address: 12 Larch Street, Hull 12345", [("street_address", "12 Larch Street")]),
    ],
)
def test_scripts_and_context(text, want):
    assert [(s.kind, text[s.start : s.end]) for s in pii.spans(text)] == want
