"""Range trees, workbooks and streams."""

import pytest
from pyspark.sql import functions as F

from quillgrid.operators.lookup import _as_of_merge
from quillgrid.sources import tree, xlsx
from quillgrid.streaming.criteria import windowed_ifs


@pytest.fixture
def book(tmp_path):
    (tmp_path / "Sales").mkdir()
    (tmp_path / "Sales" / "A1:C3").write_text("Name\tUnits\tOk\nW\\tx\t$1,200.50\tTRUE\n'5\t5%\t=B2*2\n")
    (tmp_path / "Sales" / "E5").write_text("#N/A")
    (tmp_path / "Notes").mkdir()
    (tmp_path / "Notes" / "A1-B1").write_text("\tplain\n")
    return tmp_path


def test_tree_cells_and_pruning(spark, book):
    cells = {(r["tab"], r["row"], r["col"]): r for r in tree.read_tree(spark, str(book)).collect()}
    assert cells["Sales", 2, 1]["txt"] == "W\tx" and cells["Sales", 2, 2]["num"] == 1200.5 and cells["Sales", 2, 3]["bool"] is True
    assert cells["Sales", 3, 1]["txt"] == "5" and cells["Sales", 3, 2]["num"] == 0.05 and cells["Sales", 3, 3]["src"] == "=B2*2"
    assert cells["Sales", 5, 5]["err"] == "#N/A" and cells["Notes", 1, 1]["kind"] == "blank" and cells["Notes", 1, 2]["txt"] == "plain"
    (book / "Sales" / "A9:B9").write_text("ragged\n")
    assert tree.read_tree(spark, str(book), "Sales", "B1:C2").count() == 4
    with pytest.raises(Exception, match="dimension-mismatch"):
        tree.read_tree(spark, str(book), "Sales").count()


@pytest.mark.parametrize("name, code", [("B2:D9", "overlap"), ("F1:F1", "degenerate-range"), ("H9:G1", "illegal-name")])
def test_tree_refusals(spark, book, name, code):
    (book / "Sales" / name).write_text("x\n")
    with pytest.raises(Exception, match=code):
        tree.read_tree(spark, str(book)).count()


def test_tree_round_trip_and_wide_table(spark, book):
    cells = tree.read_tree(spark, str(book), "Sales", "A1:C3")
    lines = [r["line"] for r in tree.tsv_lines(cells).orderBy("row").collect()]
    assert lines == ["Name\tUnits\tOk", "W\\tx\t1200.5\tTRUE", "'5\t0.05\t=B2*2"]
    wide = tree.table_of(cells, [(1, "name", "text"), (2, "units", "number")], 2).orderBy("__row").collect()
    assert [tuple(r) for r in wide] == [(2, "W\tx", 1200.5), (3, "5", 0.05)]


def test_letters():
    assert [tree.column_letters(n) for n in (1, 26, 27, 702, 703)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert all(tree.column_number(tree.column_letters(n)) == n for n in range(1, 2000))


def test_workbook_round_trip(spark, tmp_path):
    cells = [("One", 1, 1, "text", None, "a <b> & c", None, None, None), ("One", 2, 2, "number", 1.5, None, None, None, "=1+0.5"), ("Two & 3", 1, 3, "bool", None, None, True, None, None), ("Two & 3", 4, 28, "error", None, None, None, "#N/A", None)]
    (tmp_path / "book.xlsx").write_bytes(xlsx.workbook_bytes(cells))
    got = [tuple(r)[1:] for r in xlsx.read_xlsx(spark, f"file://{tmp_path}").orderBy("tab", "row").collect()]
    assert got == cells


def test_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    make = lambda df: windowed_ifs(df, "ts", "1 day", ["event_type"], "30 days", n=F.count("*"))
    q = make(stream).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, make(events).collect()))


@pytest.mark.parametrize("forward", [False, True])
def test_merging_as_of_join_equals_brute_force(spark, forward):
    facts = [(i, float(i * 37 % 211) / 2 if i % 50 else None) for i in range(300)]
    table = [(float(k), f"v{k}") for k in range(3, 90, 4)]
    got = {r["id"]: r["v"] for r in _as_of_merge(spark.createDataFrame(facts, "id int, x double"), "x", spark.createDataFrame(table, "k double, v string"), "k", ["v"], forward, ranges=5).collect()}
    for i, x in facts:
        near = [] if x is None else [(k, v) for k, v in table if (k >= x if forward else k <= x)]
        assert got[i] == (None if not near else (min(near) if forward else max(near))[1])
