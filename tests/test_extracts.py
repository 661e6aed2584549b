import datetime as dt
import json

import pytest

from halyard.sources import sinks
from halyard.sources.extracts import Extract, read_extract, run_extract

D = dt.date


@pytest.fixture(scope="module")
def reader(spark):
    notes = [(f"n{k}", f"{D(2024, 1, 1) + dt.timedelta(days=k):%Y%m%d}", dt.datetime(2024, 1, 1, 9, 30, 0, 500_000 if k % 2 else 0), f"标题{k}") for k in range(70)]
    spark.createDataFrame(notes, "ID string, DT string, AT timestamp, TITLE string").createOrReplaceTempView("notes")
    spark.createDataFrame([(f"n{k}", bytearray(f"正文{k}".encode())) for k in range(0, 70, 3)], "ID string, BODY binary").createOrReplaceTempView("bodies")
    return spark.sql


SPEC = Extract("notes", "notes", ["a.ID", "a.DT", "a.AT", "a.TITLE", "b.BODY"], "a.DT", joins=[("bodies", "b", "b.ID = a.ID")], text_dates=True)


def test_pieces_cover_the_window_once(reader):
    for days in (1, 7, 31, 400):
        got = [r.ID for r in read_extract(SPEC, D(2024, 1, 5), D(2024, 2, 20), reader, days).collect()]
        assert sorted(got) == sorted(f"n{k}" for k in range(4, 51))
    half = Extract("notes", "notes", ["ID", "DT"], "DT", text_dates=True, closed=False, where=["ID <> 'n5'"])
    assert sorted(r.ID for r in read_extract(half, D(2024, 1, 5), D(2024, 1, 8), reader, 2).collect()) == ["n4", "n6"]
    with pytest.raises(ValueError):
        read_extract(SPEC, D(2024, 2, 1), D(2024, 1, 1), reader)
    assert Extract("x", "t", ["A"], "A").statement(D(2024, 1, 1), D(2024, 2, 1)) == "SELECT A FROM t a WHERE A >= DATE '2024-01-01' AND A < DATE '2024-02-01'"


def test_lines_and_manifest(spark, reader, tmp_path):
    got = run_extract(spark, SPEC, D(2024, 1, 1), D(2024, 1, 10), reader, str(tmp_path), 3)
    assert got["rows"] == 10 and got["columns"] == ["ID", "DT", "AT", "TITLE", "BODY"] and sinks.read_manifest(spark, f"{tmp_path}/notes_manifest.json") == got
    lines = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/{got['file']}").collect()]
    assert [x["ID"] for x in lines] == [f"n{k}" for k in range(10)]
    assert lines[0]["BODY"] == "正文0" and lines[1]["BODY"] is None and lines[0]["AT"] == "2024-01-01 09:30:00" and lines[1]["AT"] == "2024-01-01 09:30:00.500000"
    with pytest.raises(Exception, match="exists"):
        run_extract(spark, SPEC, D(2024, 1, 1), D(2024, 1, 10), reader, str(tmp_path))
