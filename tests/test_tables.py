"""Small tables with known results: parsing, reshaping, filters, sorting and dumping."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.functions.cells import split_cell, to_float, to_int
from quillon.model import find_name, keyed
from quillon.operators import aggregate, filters, reshape, sets, sorting
from quillon.sources import store, text

BASE = """#: :sep=/\\s+/#:type=:double
#Id    ValueA    ValueB    OtherID
row1    a|aa|aaa    b    Id1|Id2
row2    A    B    Id3
row2    AA    BB    Id33
"""
PAIRS = "#ID ValueA ValueB\nrow1 A1|A11 B1|B11\nrow2 A2|A22 B2|B22\n"
REPEATED = """#: :sep=/\\s+/#:type=:double
#Id    ValueA    ValueB    OtherID
row1    a|A|a|a    b|B|b|    Id1|Id2|Id1|Id1
row2    aa|aa|AA|AA    b1|b2|B1|B2    Id1|Id1|Id2|Id2
"""


def rows(t):
    return {r[0]: tuple(r[1:]) for r in t.public().collect()}


def cell(t, key, field):
    return rows(t)[key][t.fields.index(field)]


@pytest.fixture
def base(spark):
    return text.from_text(spark, BASE)


def test_parse_merges_repeated_keys(base):
    assert cell(base, "row2", "OtherID") == ["Id3", "Id33"] and cell(base, "row2", "ValueB") == ["B", "BB"]
    assert cell(base, "row1", "ValueA") == ["a", "aa", "aaa"]


def test_parse_without_merge_keeps_the_last(spark):
    t = text.from_text(spark, BASE, merge=False)
    assert cell(t, "row2", "OtherID") == ["Id33"]


def test_parse_shapes(spark):
    assert cell(text.from_text(spark, BASE, shape="list"), "row1", "ValueA") == "a"
    assert rows(text.from_text(spark, BASE, shape="single"))["row1"] == ("a",)
    assert rows(text.from_text(spark, BASE, shape="flat"))["row1"] == (["a", "aa", "aaa", "b", "Id1", "Id2"],)
    flat = text.from_text(spark, "#: :type=:flat\n#K\tV\nk\ta\tb|c\nk\td\nl\t\n")
    assert rows(flat) == {"k": (["a", "b", "c", "d"],), "l": ([],)}


def test_parse_rekeyed_by_a_field(spark):
    t = text.from_text(spark, BASE, key_field="OtherID", fields=["Id", "ValueB"])
    assert cell(t, "Id33", "Id") == ["row2"] and cell(t, "Id2", "ValueB") == ["b"]


def test_keys_with_several_elements_and_empty_keys(spark):
    t = text.from_text(spark, "#K\tA\nk1|k2|\tx|y\n\tz\n")
    assert rows(t) == {"k1": (["x", "y"],), "k2": (["x", "y"],)}
    assert rows(text.from_text(spark, "#K\tA\nk1|k2\tx|y\n", one2one=True)) == {"k1": (["x"],), "k2": (["y"],)}


def test_cast_and_headerless(spark):
    assert rows(text.from_text(spark, "#: :type=:list#:cast=:to_i\n#K\tA\nk\t12x\nl\tx\nm\t\n", shape="list")) == {"k": (12,), "l": (0,), "m": (None,)}
    t = text.from_text(spark, "k\ta\tb\n", shape="list")
    assert t.all_fields == ("column0", "column1", "column2") and rows(t) == {"k": ("a", "b")}
    assert text.from_text(spark, "K\tA\nk\ta\n", header_mark="").fields == ("A",)


def test_spec(spark):
    t = text.from_spec(spark, {"a": ["1", "2"]}, "ID~FieldA,FieldB#:type=:list")
    assert t.key == "ID" and rows(t) == {"a": ("1", "2")}


def test_rekey_rules(base):
    strict = reshape.reorder(base, "OtherID", ["ValueA", "ValueB"], one2one="strict")
    assert cell(strict, "Id33", "ValueB") == ["BB"] and cell(strict, "Id2", "ValueB") == [None]
    fallback = reshape.reorder(base, "OtherID", ["Id", "ValueB"], one2one=True, shape="list")
    assert rows(fallback)["Id33"] == ("row2", "BB") and rows(fallback)["Id2"] == ("row1", "b")
    whole = reshape.reorder(base, "OtherID", ["ValueA"], one2one=False)
    assert cell(whole, "Id2", "ValueA") == ["a", "aa", "aaa"]


def test_change_key(spark):
    t = text.from_text(spark, PAIRS, sep=" ")
    kept = reshape.change_key(t, "ValueA", keep=True)
    assert cell(kept, "A11", "ID") == ["row1"]
    assert cell(reshape.change_key(t, "ValueA", one2one=True), "A11", "ValueB") == ["B11"]
    assert cell(reshape.change_key(t, "ValueA"), "A1", "ValueB") == ["B1", "B11"]


def test_unzip_and_zip(spark):
    t = text.from_text(spark, PAIRS, sep=" ")
    z = reshape.unzip(t, "ValueA")
    assert z.key == "ID:ValueA" and cell(z, "row1:A1", "ValueB") == "B1" and cell(z, "row2:A22", "ValueB") == "B22"
    assert set(rows(reshape.unzip_replicates(t))) == {"row1(0)", "row1(1)", "row2(0)", "row2(1)"}
    r = text.from_text(spark, REPEATED)
    merged = reshape.unzip(r, "ValueA", merge=True)
    assert cell(merged, "row1:a", "ValueB") == ["b", "b", ""]
    assert sorted(cell(reshape.zip_key(merged, "ValueA"), "row1", "ValueB")) == ["", "B", "b", "b"]


def test_remove_duplicates(spark):
    t = reshape.remove_duplicates(text.from_text(spark, REPEATED))
    assert cell(t, "row1", "ValueA") == ["a", "A", "a"] and "" in cell(t, "row1", "ValueB")


def test_melt_and_transpose(spark):
    t = text.from_text(spark, "#Size,System1,System2\n10,20,30\n20,40,60\n", sep=",", shape="list")
    assert rows(reshape.melt(t, "Time", "System")) == {"10:0": ("10", "20", "System1"), "10:1": ("10", "30", "System2"), "20:0": ("20", "40", "System1"), "20:1": ("20", "60", "System2")}
    assert rows(reshape.transpose(t, "System", ["10", "20"])) == {"System1": ("20", "40"), "System2": ("30", "60")}


def test_fields_and_columns(base):
    added = reshape.add_field(base, "n", F.when(F.col("Id") == "row1", "1"))
    assert cell(added, "row1", "n") == ["1"] and cell(added, "row2", "n") == []
    assert reshape.column(base, "ValueB").shape == "flat"
    assert rows(reshape.slice_fields(base, [])) == {"row1": (), "row2": ()}
    assert cell(reshape.process(base, "ValueA", lambda c: F.transform(c, F.upper)), "row1", "ValueA") == ["A", "AA", "AAA"]


def test_names():
    names = ["Child (Alias)", "Husband (ID)", "Date"]
    assert find_name(names, "Husband") == "Husband (ID)" == find_name(names, "ID") and find_name(names, "Alias") == "Child (Alias)"
    assert find_name(names, "Husband", strict=True) is None and find_name(["A", "A (B)"], "A (B)") == "A (B)"


def test_select(base):
    keys = lambda t: set(rows(t))
    assert keys(filters.select(base, {"ValueA": "a"})) == {"row1"} and keys(filters.select(base, {"ValueA": "a"}, invert=True)) == {"row2"}
    assert keys(filters.select(base, ["Id33", "zz"])) == {"row2"} and keys(filters.select(base, re.compile("^aaa$"))) == {"row1"}
    assert keys(filters.select(base, {"OtherID": 3})) == set() and keys(filters.select(base, {"ValueA": 3})) == {"row1"}
    assert keys(filters.select(base, {":key": ["row2"]}, invert=True)) == {"row1"}
    assert keys(filters.select(base, {"ValueA": lambda v: F.length(v) == 2})) == {"row1", "row2"}
    assert keys(filters.subset(base, ["row2", "row9"])) == {"row2"} and keys(filters.prefix(base, "row")) == {"row1", "row2"}
    assert [r.requested for r in filters.values_at(base, ["row2", "x"]).collect()] == ["row2", "x"]
    stack = filters.FilterStack(base).add("field:ValueB", "b")
    assert keys(stack.result()) == {"row1"}
    with stack.having("key", "row2") as none:
        assert keys(none) == set()
    assert keys(stack.result()) == {"row1"}


def test_long_key_lists_become_joins(base):
    found = filters.select(base, {":key": [f"row{i}" for i in range(2, 3000)]})
    assert set(rows(found)) == {"row2"} and "Join" in found.df._jdf.queryExecution().optimizedPlan().toString()


def test_nulls_are_not_selected_and_are_when_inverted(spark):
    t = keyed(spark.createDataFrame([("a", None), ("b", "5")], "k string, v string"), "k", shape="list")
    assert set(rows(filters.select(t, {"v": ">1"}))) == {"b"} and set(rows(filters.select(t, {"v": ">1"}, invert=True))) == {"a"}


def test_sort_and_pages(spark):
    t = text.from_text(spark, "#Id ValueA\nrow1 a\nrow2 A\nrow3 b|c\nrow4 \n", sep=" ")
    assert [r.Id for r in sorting.sort_by(t, "ValueA").collect()] == ["row4", "row2", "row1", "row3"]
    assert [r.Id for r in sorting.page(t, 2, 3).collect()] == ["row4"] and sorting.page(t, 9, 3).count() == 0
    assert [r.Id for r in sorting.head(t, 2).collect()] == ["row1", "row2"]


def test_sets(spark):
    a = text.from_text(spark, "#K V\nrow1 A\nrow2 AA\n", sep=" ")
    b = text.from_text(spark, "#K V\nrow2 BB\nrow3 B\n", sep=" ")
    assert rows(sets.merge_zip(a, b)) == {"row1": (["A"],), "row2": (["AA", "BB"],), "row3": (["B"],)}
    assert rows(sets.overlay(a, b))["row2"] == (["BB"],) and set(rows(sets.without(a, b))) == {"row1"} and set(rows(sets.common_keys([a, b]))) == {"row2"}


def test_one2one_padding(spark):
    t = text.from_text(spark, "#K A B\nk a1 \nk a2 b2\n", sep=" ", one2one=True)
    assert rows(t)["k"] == (["a1", "a2"], [None, "b2"])


def test_match_counts(base):
    assert {r.field: r.n for r in aggregate.field_match_counts(base, ["a", "aa", "row1", "BB", "none"]).collect()} == {"ValueA": 2, "Id": 1, "ValueB": 1}


def test_gaps_are_taken_out(spark):
    jobs = spark.sql("select task, timestamp_seconds(s) as start, timestamp_seconds(e) as end from values ('a', 0, 10), ('b', 5, 8), ('c', 20, 25), ('d', 40, 41) as v(task, s, e)")
    assert {r.task: (r.start_s, r.end_s) for r in aggregate.trace_times(jobs).collect()} == {"a": (0, 10), "b": (5, 8), "c": (10, 15), "d": (15, 16)}


def test_dump_and_read_again(base, spark):
    path = store.work_path(spark, "dump")
    text.write_tsv(base, path)
    assert rows(text.read_dump(spark, path)) == rows(base)
    assert sorted(r.value for r in text.dump_lines(base, unmerge="expand").filter("value like 'row1%'").collect()) == ["row1\ta\tb\tId1", "row1\taa\tb\tId2", "row1\taaa\tb\t"]
    plain = store.work_path(spark, "plain")
    spark.createDataFrame([(BASE,)], "value string").coalesce(1).write.text(plain)
    read = text.read_tsv(spark, plain, grep="row1")
    assert rows(read) == {"row1": rows(base)["row1"]} and text.all_fields(spark, plain) == ["Id", "ValueA", "ValueB", "OtherID"]
    assert rows(text.read_tsv(spark, plain, field="ValueB")) == {"row1": ("b",), "row2": ("B",)}
    assert set(rows(text.read_tsv(spark, plain, head=1))) == {"row1"}


def test_csv(spark):
    path = store.work_path(spark, "csv")
    spark.createDataFrame([("Key,FieldA,FieldB\nk1,a,b\nk2,aa,bb",)], "value string").coalesce(1).write.text(path)
    assert rows(text.read_csv(spark, path)) == {"k1": ("a", "b"), "k2": ("aa", "bb")}
    assert rows(text.read_csv(spark, path, headers=False))["row-0"] == ("Key", "FieldA", "FieldB")


def test_stores(base, spark):
    path = store.work_path(spark, "kv")
    store.save(base, path, sorted_by_key=True)
    assert rows(store.load(spark, path)) == rows(base) and store.get(store.load(spark, path), "row1").count() == 1
    shard = lambda k: F.right(k, F.lit(1))
    sharded = store.work_path(spark, "shard")
    store.save_sharded(base, sharded, shard)
    found = store.get_sharded(spark, sharded, shard, ["row2"])
    assert set(rows(found)) == {"row2"} and "PartitionFilters: [isnotnull(shard" in found.df._jdf.queryExecution().toString()
    calls = []
    for _ in range(2):
        store.cached(spark, store.work_path(spark, "c") if not calls else calls[0], "t", {"a": 1}, lambda: base)
        calls.append(path)


def test_casts(spark):
    got = spark.createDataFrame([("12abc",), (" -3.5e1x",), ("abc",), ("",), (None,)], "v string").select(to_int(F.col("v")), to_float(F.col("v"))).collect()
    assert [tuple(r) for r in got] == [(12, 12.0), (-3, -35.0), (0, 0.0), (None, None), (None, None)]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text("ab|c", max_size=6), max_size=6))
def test_split_cell_as_in_python(spark, cells):
    got = spark.createDataFrame([(c,) for c in cells] or [("",)], "v string").select("v", split_cell(F.col("v")).alias("s")).collect()
    assert all(r.s == (r.v.split("|") if r.v else []) for r in got)


def test_csv_scan_writes_with_the_partitions_of_its_table(spark, monkeypatch):
    from pyspark.sql import functions as F

    from quillon.plans import queries

    read, place, paths = queries.table, queries.store.work_path, []
    monkeypatch.setattr(queries, "table", lambda *a: read(*a).repartition(3))
    monkeypatch.setattr(queries.store, "work_path", lambda *a: paths.append(place(*a)) or paths[-1])
    assert queries.QUERIES["csv_scan"](spark, "/root/testdata/sf0.001").count() == read(spark, "/root/testdata/sf0.001", "customer").count()
    assert spark.read.text(paths[0]).select(F.input_file_name()).distinct().count() == 3


def test_reorder_into_one_cell(spark):
    t = text.from_text(spark, "#ID A B\nr1 a|aa b\nr2 a c|cc\n", sep=" ")
    assert rows(reshape.reorder(t, "A", ["ID", "B"], one2one=False, shape="flat")) == {"a": (["r1", "b", "r2", "c", "cc"],), "aa": (["r1", "b"],)}
    assert rows(reshape.reorder(t, "A", ["B", "ID"], one2one=False, shape="single")) == {"a": ("c",), "aa": ("b",)}
