import pytest

from tracefold.llm import pii


def kinds(text):
    flat, _ = pii.collapse_space(text)
    return [(s.kind, flat[s.start : s.end]) for s in pii.mentions(flat)]


@pytest.mark.parametrize(
    "text,expected",
    [
        ("Correspondence: Dr. Ann B. Bellweather, 70 N. Farmer Lane, Apt. 4B, Town; e-mail a.b+c@lab.example.org.",
         [("name", "Ann B. Bellweather"), ("address", "70 N. Farmer Lane, Apt. 4B"), ("email", "a.b+c@lab.example.org")]),
        ("write to ann_b AT lab DOT example DOT com or c (at) d", [("email", "ann_b AT lab DOT example DOT com")]),
        ("mail x [at] cs [dot] uni [dot] test.", [("email", "x [at] cs [dot] uni [dot] test")]),
        ("Recall@5 rose, pipeline@2.1.3 ran.", []),
        ("Tel. +1 212 555 0144; fax (212) 555-0145 ext. 9.", [("phone", "+1 212 555 0144"), ("phone", "(212) 555-0145")]),
        ("Grant 555-0145-41, ISBN 978-0-00-688181-4, ISSN 2041-6223, pp. 5821-268428, Sample 0000-6790-17", []),
        ("checked by leilani bellweather, ORCID 0000-0002-1825-0097.", [("name", "leilani bellweather"), ("id_number", "0000-0002-1825-0097")]),
        ("was checked by two readers, and by hand", []),
        ("The Bellweather criterion and the Bellweather–Danequist index (Bellweather et al., 1990) at the Bellweather Institute.", []),
        ("DNI 12345678-Z, a nombre de Ana de Danequist. Escribir a x@y.example", [("id_number", "12345678-Z"), ("name", "Ana de Danequist"), ("email", "x@y.example")]),
        ("Rückfragen an C. Danequist, Tel. +49 30 23125070, Am Bergerhof 12.", [("name", "C. Danequist"), ("phone", "+49 30 23125070"), ("address", "Am Bergerhof 12")]),
        ("Joindre Luc van der Bellweather au 01 99 00 12 34. habite 3 bis, rue de Danequist.",
         [("name", "Luc van der Bellweather"), ("phone", "01 99 00 12 34"), ("address", "3 bis, rue de Danequist")]),
        ("感谢 Ann Bellweather 的意见。 联系电话:020 7946 0010。", [("name", "Ann Bellweather"), ("phone", "020 7946 0010")]),
        ("We thank Ann Bellweather and Prof. Cy Danequist for reading. We thank the anonymous referees.", [("name", "Ann Bellweather"), ("name", "Cy Danequist")]),
        ("few. Bellweather, Ann died in the spring", [("name", "Bellweather, Ann")]),
        ("the form gives 986 47 6002 for Ann Bellweather.", [("id_number", "986 47 6002"), ("name", "Ann Bellweather")]),
        ("After 49 road tests and 17 street surveys", []),
        ("", []),
    ],
)
def test_mentions(text, expected):
    assert kinds(text) == expected


def test_checksums():
    assert pii.orcid_valid("0000000218250097") and not pii.orcid_valid("0000000218250098")
    assert pii.luhn_valid("4539578763621486") and not pii.luhn_valid("4539578763621487")
    assert pii.dni_valid("12345678Z") and not pii.dni_valid("12345678A")
    assert pii.tax_valid("86095742719") and not pii.tax_valid("86095742718")
    body = 2551199123456
    assert pii.mod97_valid(f"{body}{97 - body % 97:02d}") and not pii.mod97_valid(f"{body}00")


def test_documents(spark):
    text = "Correspondence:  Ann Bellweather,\n70 Farmer\n Road; fax\n+1 212 555 0144. Correspondence: Ann Bellweather, x."
    docs = spark.createDataFrame([(1, text, "x"), (2, None, "x"), (3, "", "x"), (4, "plain " * 20_000 + "mail a@b.example", "x"), (5, text, "x"), (5, text, "x")], "doc_id long, text string, kind string")
    got = sorted(tuple(r) for r in pii.personal_mentions(docs).collect())
    own = [("address", "70 Farmer Road"), ("name", "Ann Bellweather"), ("phone", "+1 212 555 0144")]
    assert got == [(1, *m) for m in own] + [(4, "email", "a@b.example")] + [(5, *m) for m in own]
    texts = {r.doc_id: r.redacted for r in pii.redacted_text(docs).collect()}
    assert texts[1] == "Correspondence:  [NAME],\n[ADDRESS]; fax\n[PHONE]. Correspondence: [NAME], x."
    assert texts[2] is None and texts[3] == "" and texts[4].endswith("mail [EMAIL]")
    assert pii.personal_mentions(docs.limit(0)).count() == 0


#: Sentences that no cue was written for.
HELD_OUT = [
    ("The referee was Jane Holloway.", "Jane Holloway"), ("Please ask Jane Holloway for the data.", "Jane Holloway"),
    ("Our patient, Maria Lopez, lives nearby.", "Maria Lopez"), ("Data were collected by Tom Fischer.", "Tom Fischer"),
    ("Jane Holloway wrote the code.", "Jane Holloway"), ("Dr. Peter Okafor called on Monday.", "Peter Okafor"),
    ("We spoke with Lena Brandt about the samples.", "Lena Brandt"), ("Kind regards, Samuel Ortiz", "Samuel Ortiz"),
    ("Mit freundlichen Grüßen Heike Vogel", "Heike Vogel"), ("Je remercie Mme Claire Fontaine pour sa lecture.", "Claire Fontaine"),
    ("The interviews were conducted by Aisha Rahman and others.", "Aisha Rahman"), ("Questions should be sent to Igor Petrov.", "Igor Petrov"),
    ("Our supervisor Hannah Weiss agreed to the change.", "Hannah Weiss"), ("Prof. Luis Romero replied within a week.", "Luis Romero"),
    ("The form was signed by Ms Carol Dean.", "Carol Dean"), ("El paciente Diego Ramos firmó el formulario.", "Diego Ramos"),
    ("Les données ont été relues; écrire à Mme Anne Petit.", "Anne Petit"), ("Contact Bruno Keller if the link is broken.", "Bruno Keller"),
    ("The letter was written by Olga Ivanova.", "Olga Ivanova"), ("Dear Ruth Campbell, we received your form.", "Ruth Campbell"),
    ("Frau Monika Schulz hat den Bogen geprüft.", "Monika Schulz"), ("Copies can be had from George Lamb.", "George Lamb"),
    ("I owe this remark to Nadia Haddad.", "Nadia Haddad"), ("The participant, named Tim Larsen, withdrew.", "Tim Larsen"),
    ("As Emma Clarke said, the rate fell.", "Emma Clarke"), ("Atentamente, Pilar Gómez", "Pilar Gómez"),
]


def test_names_in_sentences_of_other_kinds():
    got = [[v for k, v in kinds(t) if k == "name"] for t, _ in HELD_OUT]
    assert sum(n in g for (_, n), g in zip(HELD_OUT, got)) / len(HELD_OUT) >= 0.9
    assert sum(len(g) for g in got) <= len(HELD_OUT)


@pytest.mark.parametrize(
    "text,right",
    [
        ("Jane Holloway (0000-0002-1825-0097) has it", True), ("Jane Holloway (0000-0002-1825-0098) has it", False),
        ("under 2 55 11 99 123 456 68 we", True), ("under 2 55 11 99 123 456 69 we", False),
        ("belongs to 12345678Z here", True), ("belongs to 12345678A here", False), ("belongs to X1234567L here", True), ("belongs to X1234567A here", False),
        ("my tax 86 095 742 719 since", True), ("my tax 86 095 742 718 since", False),
        ("of 11010519491231002X in", True), ("of 110105194912310021 in", False),
    ],
)
def test_checksums_decide_where_no_label_does(text, right, monkeypatch):
    ids = lambda: [v for k, v in kinds(text) if k == "id_number"]
    assert bool(ids()) == right
    monkeypatch.setattr(pii, "checksum", lambda value: not right)
    assert bool(ids()) != right


def test_a_whole_chinese_number_and_lists_after_any_cue():
    assert kinds("身份证号: 110105194912310021。") == [("id_number", "110105194912310021")]
    assert kinds("Nous remercions Anne Durand et Luc Moreau.") == [("name", "Anne Durand"), ("name", "Luc Moreau")]


def test_many_mentions_in_one_text():
    text = "mail a@b.example, tel. +1 212 555 0144. " * 20_000
    assert len(kinds(text)) == 40_000
    assert kinds("x" * 200_000 + "@lab.example.org")[0][1].endswith("x@lab.example.org")
