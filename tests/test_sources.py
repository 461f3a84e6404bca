import os

import pytest

from ledgerlark.sources import csv_layouts as cl
from ledgerlark.sources import documents as dc
from ledgerlark.sources import store as st

HEADER = "TRANSACTION_ID,TX_DATETIME,CUSTOMER_ID,TERMINAL_ID,TX_AMOUNT,TX_TIME_SECONDS,TX_FRAUD,TX_FRAUD_SCENARIO"


def write(tmp_path, name, lines):
    path = os.path.join(tmp_path, name)
    with open(path, "w", encoding="utf-8") as out:
        out.write("\n".join(lines) + "\n")
    return path


def test_customer_and_terminal_of_one_name_stay_apart(spark, tmp_path):
    lines = [f"t{i},x,k{i % 3},k{(i + 1) % 3},{i}.25,{60 * (i // 4)},{'' if i % 5 == 4 else i % 2},0" for i in (7, 3, 11, 0, 8, 4)]
    stream = cl.read_handbook(spark, write(tmp_path, "h.csv", [HEADER, *lines]))
    rows = stream.events.orderBy("event_us", "arrival_seq").collect()
    assert [r["event_id"] for r in rows] == ["t3", "t0", "t7", "t4", "t11", "t8"]  # by time, then as they arrived
    for r in rows:
        i = int(r["event_id"][1:])
        assert [(e["kind"], e["id"], e["role"]) for e in r["entities"]] == [
            ("customer", f"k{i % 3}", "source"), ("terminal", f"k{(i + 1) % 3}", "destination")
        ]
        assert r["features"] == {"amount": i + 0.25}
    labels = {r["event_id"]: r["label"] for r in stream.outcomes.collect()}
    assert labels == {"t0": 0, "t3": 1, "t4": -1, "t7": 1, "t8": 0, "t11": 1}


@pytest.mark.parametrize(
    "line, rule",
    [
        ("n,x,c,t,-0.01,90,1,0", "range TX_AMOUNT"),
        ("n,x,c,t,1e999,90,1,0", "range TX_AMOUNT"),
        ("n,x,c,t,6,soon,1,0", "range TX_TIME_SECONDS"),
        (" ,x,c,t,6,90,1,0", "blank TRANSACTION_ID"),
        ("n,x,c,  ,6,90,1,0", "blank TERMINAL_ID"),
        ("n,x,c,t,6,90,-3,0", "label-value"),
        ("n,x,c,t,6,90,1,0,0", "row-width"),
        ("first,x,c,t,6,90,1,0", "event-id-repeated"),
    ],
)
def test_first_broken_rule_is_named(spark, tmp_path, line, rule):
    path = write(tmp_path, "bad.csv", [HEADER, "first,x,c1,t1,8.5,30,1,2", line, "last,x,c2,t2,9,95,0,0"])
    with pytest.raises(ValueError, match=rule):
        cl.read_handbook(spark, path)


def test_columns_that_a_header_lacks_are_listed(spark, tmp_path):
    path = write(tmp_path, "m.csv", ["TX_AMOUNT,TERMINAL_ID,TRANSACTION_ID", "4,t,a"])
    with pytest.raises(ValueError, match="header-lacks CUSTOMER_ID, TX_TIME_SECONDS"):
        cl.read_handbook(spark, path)


def test_file_order_and_row_numbers(spark, tmp_path):
    b = write(tmp_path, "b.csv", ["k", "b1", "b2"])
    a = write(tmp_path, "a.csv", ["k", "a1"])
    rows = cl.scan_csv_files(spark, [b, a]).orderBy(cl.SEQ).collect()
    assert [(r["k"], r[cl.FILE], r[cl.ROW]) for r in rows] == [("b1", 0, 1), ("b2", 0, 2), ("a1", 1, 1)]
    folder = cl.scan_csv_files(spark, str(tmp_path)).orderBy(cl.SEQ).collect()
    assert [r["k"] for r in folder] == ["a1", "b1", "b2"]


def test_rows_of_many_splits_are_numbered_without_a_sort_and_parsed_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name, rows in (("a.csv", range(900)), ("b.csv", range(900, 1000))):
        lines = [f"t{i},x,c{i % 7},t{i % 5},{i}.5,{60 * i},{i % 2},0" for i in rows]
        write(str(folder), name, [HEADER, *lines])
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        scanned = cl.scan_csv_files(spark, str(folder))
        rows = scanned.orderBy(cl.SEQ).collect()
        plan = scanned._jdf.queryExecution().executedPlan().toString()
        parsed, _ = cl.read_parsed(spark, "handbook", str(folder))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert [(r[cl.SEQ], r["TRANSACTION_ID"]) for r in rows] == [(i, f"t{i}") for i in range(1000)]
    assert [r[cl.ROW] for r in rows] == [*range(1, 901), *range(1, 101)]
    assert "row_number" not in plan
    assert "Scan csv" not in parsed._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["arrival_seq"] for r in parsed.collect()) == [*range(1000)]


def test_numbers_of_the_anonymous_layout(spark, tmp_path):
    names = ["Time", *[f"V{i}" for i in range(1, 29)], "Amount", "Class"]
    good = ["5", *["-1.5"] * 28, "3", "1"]
    stream = cl.read_ulb(spark, write(tmp_path, "u.csv", [",".join(names), ",".join(good)]))
    assert stream.events.first()["features"] == {"amount": 3.0} | {f"V{i}": -1.5 for i in range(1, 29)}
    for at, text, rule in ((0, "-1", "range Time"), (3, "NaN", "number V3"), (29, "-2", "number amount"), (28, "x", "number V28")):
        bad = [*good[:at], text, *good[at + 1 :]]
        with pytest.raises(ValueError, match=rule):
            cl.read_ulb(spark, write(tmp_path, f"bad{at}.csv", [",".join(names), ",".join(good), ",".join(bad)]))


def test_document_rules(spark, tmp_path):
    text = (
        '{"schema":"payment-events/v1","accounts":[{"id":0},{"id":1}],"events":['
        '{"id":"d","kind":"deposit","t":0,"u":-1,"v":0,"amount":5},'
        '{"id":"p","kind":"payment","t":1,"u":0,"v":1,"amount":2}],'
        '"truth":{"p":true},"label_available_at":{"p":%s}}'
    )
    good = dc.read_payment_json(spark, write(tmp_path, "g.json", [text % "3"]))
    assert good.outcomes.first()["label"] == 1 and good.events.count() == 2
    with pytest.raises(ValueError, match="availability-early"):
        dc.read_payment_json(spark, write(tmp_path, "b.json", [text % "0.5"]))


def test_large_intervals_are_refused(spark):
    rows = [(i, [("account", f"a{i % 7}"), ("account", f"b{i}")]) for i in range(30)]
    events = spark.createDataFrame(rows, "event_us long, entities array<struct<kind: string, id: string>>")
    assert st.guard_interval(events, 30, 37).count() == 30
    for limits in ((29, 37), (30, 36)):
        with pytest.raises(ValueError, match="choose a shorter one"):
            st.guard_interval(events, *limits)
