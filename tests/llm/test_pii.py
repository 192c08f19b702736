import datetime as dt
import re

from molgrid.llm import pii

KEY = b"k"


def test_permutation_is_one_to_one():
    for size in (1, 2, 10, 97, 1000):
        image = [pii.permute(v, size, KEY, b"t") for v in range(size)]
        assert sorted(image) == list(range(size))
        assert [pii.permute(v, size, KEY, b"t", back=True) for v in image] == list(range(size))


def test_formats_stay_valid():
    text = "mail A.b7@c-d.example.com, IP 10.20.30.40. card 4111 1111 1111 1111, IBAN DE89 3704 0044 0532 0130 00, +1 (017) 555-7713, ssn 123-45-6789, on 2021-02-28 and 31.12.1999 and 12/25/2001; token = \"9b0b3c6a43eb78aa99cbd7049c572391524f37a8\""
    new, found = pii.rewrite(text, KEY)
    assert found == {"email": 1, "ip": 1, "card": 1, "iban": 1, "phone": 1, "ssn": 1, "date": 3, "token": 1}
    assert re.sub(r"[A-Za-z0-9]", "", new) == re.sub(r"[A-Za-z0-9]", "", text)
    card = re.sub(r"\D", "", re.search(r"card ([\d ]+),", new)[1])
    assert len(card) == 16 and pii.luhn(card[:-1]) == int(card[-1]) and card != "4" + "1" * 15
    dt.date.fromisoformat(re.search(r"\d{4}-\d{2}-\d{2}", new)[0])
    assert pii.rewrite(new, KEY, back=True)[0] == text


def test_invalid_values_stay():
    for text in ("4111 1111 1111 1112", "999.1.1.1", "2021-02-30", "000-12-3456", "version 1.2.3.4.5", "DE00 3704 0044 0532 0130 00", "1234", "a@b", ""):
        assert pii.rewrite(text, KEY) == (text, {})


def test_equal_values_stay_linked_and_keys_differ():
    a, b = (pii.rewrite(t, KEY)[0] for t in ("x 4111111111111111 y", "4111 1111 1111 1111"))
    assert a.split()[1] == b.replace(" ", "")
    upper, lower = (pii.rewrite(t, KEY)[0] for t in ("JO@EXAMPLE.COM", "jo@example.com"))
    assert upper.lower() == lower
    assert pii.rewrite("jo@example.com", b"other")[0] != lower


def test_round_trip_on_the_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    there = pii.pseudonymize(docs, KEY)
    assert there.columns == docs.columns
    before = {r.doc_id: r.text for r in docs.collect()}
    after = {r.doc_id: r.text for r in there.collect()}
    assert sum(before[k] != after[k] for k in before) > 20
    assert {r.doc_id: r.text for r in pii.reveal(there, KEY).collect()} == before


def test_edge_rows(edge_docs, edge_rows, no_docs):
    rows = pii.report(edge_docs, KEY).collect()
    assert sorted(((r.doc_id, r.text) for r in rows), key=repr) == sorted(edge_rows, key=repr)
    assert all(r.n_values == 0 for r in rows)
    assert pii.report(no_docs, KEY).count() == 0


def test_dates_in_every_format_and_leap_days():
    import datetime as dt

    key = b"k"
    for day in (dt.date(2000, 2, 29), dt.date(2004, 2, 29), dt.date(1996, 2, 29), dt.date(1987, 7, 31), dt.date(2021, 5, 4)):
        new = {}
        for style in ("%Y-%m-%d", "%d.%m.%Y", "%d/%m/%Y", "%m/%d/%Y", "%m-%d-%Y"):
            if day.day < 13 and style.startswith("%m"):
                continue  # read as day first
            text, found = pii.rewrite(f"on {day.strftime(style)} it was", key)
            assert found == {"date": 1} and day.strftime(style) not in text
            assert pii.rewrite(text, key, back=True)[0] == f"on {day.strftime(style)} it was"
            new[style] = dt.datetime.strptime(text[3:13], style).date()
        assert len(set(new.values())) == 1  # equal days stay linked, however they are written
