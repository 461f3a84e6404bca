"""Many payment documents side by side: each keeps its own accounts, clock and rules."""

import json

import pytest

from ledgerlark.sources import documents as dc


def document(name, times=(1.0, 2.0), **changes):
    events = [
        {"id": f"e{i}", "kind": "payment", "t": t, "u": i % 2, "v": 1 - i % 2, "amount": 5.0, "settled": True} for i, t in enumerate(times)
    ]
    accounts = [{"id": i, "external_id": f"{name}:{i}"} for i in range(2)]
    return {"schema": "payments", "name": name, "accounts": accounts, "events": events,
            "truth": {"e0": "true", "e1": "unknown"}, "label_available_at": {"e0": 9.0}, **changes}


def store(path, *documents, text=""):
    path.mkdir()
    half = len(documents) // 2
    for i, part in enumerate((documents[:half], documents[half:])):
        (path / f"part-{i}.json").write_text("".join(json.dumps(d) + "\n" for d in part) + (text if i else ""))
    return str(path)


def test_lines_and_files(spark, tmp_path):
    # Equal event ids and account indices in two documents are no conflict; the clock starts again in each.
    docs = [document("one"), document("two", times=(0.0, 0.5)), document("three", events=[], truth={}, label_available_at={})]
    read = dc.read_payment_documents(spark, store(tmp_path / "lines", *docs))
    got = sorted((r.document, r.id, r.t) for r in read.events.collect())
    assert got == [("one", "e0", 1.0), ("one", "e1", 2.0), ("two", "e0", 0.0), ("two", "e1", 0.5)]
    assert sorted((r.document, r.id, r.label, r.available_at) for r in read.outcomes.collect()) == [("one", "e0", 1, 9.0), ("two", "e0", 1, 9.0)]
    assert sorted((r.document, r.id, r.name) for r in read.accounts.filter("document = 'two'").collect()) == [("two", 0, "two:0"), ("two", 1, "two:1")]
    files = tmp_path / "files"
    files.mkdir()
    for d in docs[:2]:
        (files / f"{d['name']}.json").write_text(json.dumps(d, indent=1))
    whole = dc.read_payment_documents(spark, str(files), lines=False)
    assert sorted((r.document.rsplit("/", 1)[1], r.id) for r in whole.events.collect()) == [
        (f"{n}.json", e) for n in ("one", "two") for e in ("e0", "e1")
    ]


@pytest.mark.parametrize("bad, rule", [
    (document("two", times=(2.0, 1.0)), "document 'two', row 1: event 'e1': event-order"),
    (document("one"), "document-name-repeated"),
    (document(None), "document-unnamed"),
    (document("two", accounts=[]), "document 'two', row -1: event 'accounts': accounts-none"),
    (document("two", accounts=[{"id": 1}, {"id": 2}]), "account-gaps"),
    (document("two", accounts=[{"id": 0, "external_id": "x"}, {"id": 1, "external_id": "x"}]), "account-name-repeated"),
    (document("two", truth={"e9": "true"}, label_available_at={}), "outcome-unpaid"),
    (document("two", label_available_at={"e1": 9.0}), "availability-unlabelled"),
    (document("two", label_available_at={"e0": 0.5}), "availability-early"),
])
def test_rules_name_the_document(spark, tmp_path, bad, rule):
    with pytest.raises(ValueError, match=rule):
        dc.read_payment_documents(spark, store(tmp_path / "bad", document("one"), bad))


def test_damaged_line_is_not_lost(spark, tmp_path):
    path = store(tmp_path / "cut", document("one"), document("two"), text='{"name": "three", "accou')
    with pytest.raises(ValueError):
        dc.read_payment_documents(spark, path)
