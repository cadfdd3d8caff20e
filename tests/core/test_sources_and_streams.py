"""Files and event streams on literal rows."""

import datetime

import pytest

from reachloom.sources import files
from reachloom.streaming import events


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Name;Work Email\nAnn;a@example.com\n;\n")
    (tmp_path / "b.csv").write_text("Name,Phone\nBob,12\n")
    both = files.read_sheets(spark, {"A": str(tmp_path / "a.csv"), "B": str(tmp_path / "b.csv")})
    assert sorted((r["sheet"], r["Name"], r["Phone"]) for r in both.collect()) == [("A", "Ann", None), ("B", "Bob", "12")]
    with pytest.raises(ValueError):
        files.read_contacts_csv(spark, "x.xlsx")
    files.write_csv(both, str(tmp_path / "out"), files.EXPORT_COLUMNS["rejections"])
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).columns == files.EXPORT_COLUMNS["rejections"]
    files.write_sheets({"x": both.select("Name")}, str(tmp_path / "book"))
    files.write_json(both.select("Name"), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == spark.read.parquet(str(tmp_path / "book" / "x")).count() == 2


def test_streams(spark, tmp_path):
    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    rows = [("1", "c", "r1", "SENT", at(0), "p1"), ("2", "c", "r1", "OPENED", at(1), "p2"), ("3", "c", "r1", "OPENED", at(1), "p2"),
            ("4", "c", "r2", "BOUNCED", at(2), "p3"), ("5", "c", "r2", "OPENED", at(3), "p4")]
    folder = str(tmp_path / "events")
    spark.createDataFrame(rows, files.MESSAGE_EVENTS).write.parquet(folder)
    stream = events.distinct_events(events.read_events(spark, folder))
    for name, df, mode in (("once", stream, "append"), ):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
    assert spark.table("once").count() == 4
    state = events.read_events(spark, folder)
    q = events.recipient_state(state).writeStream.format("memory").queryName("state").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["recipient_id"]: (r["open_count"], r["status"]) for r in spark.table("state").collect()} == {"r1": (2, "OPENED"), "r2": (1, "BOUNCED")}
    for _ in range(2):  # a restart adds nothing
        events.suppress(events.read_events(spark, folder), str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    assert [r["recipient_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["r2"]


def test_encodings(spark, tmp_path):
    (tmp_path / "u.csv").write_bytes("\ufeffName,City\nÀnn,Köln\n".encode())
    (tmp_path / "w.csv").write_bytes("Name,City\nAnn’s,Köln\n".encode("cp1252"))
    (tmp_path / "l.csv").write_bytes(b"Name,City\nAnn\x81,K\xf6ln\n")
    read = lambda n: files.read_contacts_csv(spark, str(tmp_path / n)).first()
    assert read("u.csv")["Name"] == "Ànn" and read("w.csv")["Name"] == "Ann’s" and read("l.csv")["City"] == "Köln"


def test_a_batch_that_runs_again_writes_the_same(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    rows = [("1", "c", "r1", "BOUNCED", at, "p1"), ("2", "c", "r2", "UNSUBSCRIBED", at, "p2")]
    folder = str(tmp_path / "events")
    spark.createDataFrame(rows, files.MESSAGE_EVENTS).write.parquet(folder)
    for mark in ("one", "two"):  # another checkpoint: the same batch number comes again
        events.suppress(events.read_events(spark, folder), str(tmp_path / "out"), str(tmp_path / mark)).awaitTermination()
    assert sorted(r["recipient_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["r1", "r2"]
