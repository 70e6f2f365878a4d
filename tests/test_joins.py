"""Small tables with known results: joins, indexes, translation, ranges, graphs, entities and workflows."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quillon.model import keyed
from quillon.operators import graph, joins, knowledge, ranges, translate
from quillon.operators.entity import Entity, annotation_table, entity_of, from_annotation_table, typed
from quillon.operators.knowledge import KnowledgeBase
from quillon.operators.workflow import Failed, Input, MissingInput, Workflow
from quillon.sources import store, text
from quillon.streaming import tables as streams
from tests.test_tables import PAIRS, cell, rows


def table(spark, body, sep=" ", **options):
    return text.from_text(spark, body, sep=sep, **options)


def test_attach_complete(spark):
    a = table(spark, "#ID ValueA ValueB\nrow1 a|aa|aaa b\nrow2 A B\n")
    b = table(spark, "#ID ValueB OtherID\nrow1 b Id1|Id2\nrow3 B Id3\n")
    t = joins.attach(a, b, complete=True)
    assert t.fields == ("ValueA", "ValueB", "OtherID")
    assert rows(t) == {"row1": (["a", "aa", "aaa"], ["b"], ["Id1", "Id2"]), "row2": (["A"], ["B"], []), "row3": ([], ["B"], ["Id3"])}


def test_rows_of_equal_key_and_order_keep_their_own_matches(spark):
    values = [("r", ["x"]), ("r", ["y"]), ("r", ["y"]), (None, ["y", "q"]), ("s", [])]
    a = keyed(spark.createDataFrame(values, "ID string, ValueA array<string>"), "ID", shape="double", order=F.lit(0))
    b = table(spark, "#ValueA Other\nx X\ny Y\n")
    found = joins.attach(a, b, match_key="ValueA").public().collect()
    assert sorted((r.ID or "", r.ValueA, r.Other) for r in found) == [("", ["y", "q"], ["Y"]), ("r", ["x"], ["X"]), ("r", ["y"], ["Y"]), ("r", ["y"], ["Y"]), ("s", [], [])]
    for keep, last in ((False, ["Y"]), (True, ["Y", None])):
        found = translate.translate(a, "ValueA", "Other", [b], keep_unresolved=keep).public().collect()
        assert sorted((r.ID or "", r.Other) for r in found) == [("", last), ("r", ["X"]), ("r", ["Y"]), ("r", ["Y"]), ("s", [])]


def test_attach_singles_become_lists(spark):
    a = table(spark, "#ID ValueA\nrow1 a\nrow2 A\n", shape="single")
    b = table(spark, "#ID ValueB\nrow1 b\nrow3 c\n", shape="single")
    assert rows(joins.attach(a, b)) == {"row1": ("a", "b"), "row2": ("A", None)}


def test_attach_by_column_and_by_other_key(spark):
    a = table(spark, PAIRS)
    by_column = joins.attach(a, table(spark, "#ValueB OtherID\nB1 Id1\nB11 Id11\nB2 Id2.2\nB22 Id22.2\n"), match_key="ValueB")
    assert cell(by_column, "row2", "OtherID") == ["Id2.2", "Id22.2"]
    keyed_apart = joins.attach(a, table(spark, "#OtherID ValueB\nId1 B1\nId11 B11\n"), match_key="ValueB", other_key="ValueB")
    assert cell(keyed_apart, "row1", "OtherID") == ["Id1", "Id11"]


def test_attach_policies(spark):
    a = table(spark, "#ID V\nrow1 x\nrow2 \n", shape="list")
    b = table(spark, "#ID V\nrow1 y\nrow2 z\n")
    assert rows(joins.attach(a, b)) == {"row1": ("x",), "row2": ("z",)}
    c, d = table(spark, "#ID V\nr x\n"), table(spark, "#ID V\nr y|y|x\n")
    assert rows(joins.attach(c, d))["r"] == (["x", "y", "y"],)
    fuzzy = joins.attach(a, text.from_text(spark, "#Identifiers (ID)\tW\nrow1\tw\n"))
    assert cell(fuzzy, "row1", "W") == "w"


def test_attach_through_an_index(spark):
    index = spark.createDataFrame([("row1", "e1"), ("row1", "e2"), ("row2", "e3")], "value string, target string")
    t = joins.attach(table(spark, "#Id A\nrow1 a\nrow2 b\nrow3 c\n"), table(spark, "#ValueE OtherID\ne1 Id1\ne2 Id2\n"), ["OtherID"], index=index)
    assert rows(t) == {"row1": (["a"], ["Id1", "Id2"]), "row2": (["b"], []), "row3": (["c"], [])}


def test_index_first_wins(spark):
    t = table(spark, "#Id ValueA ValueB OtherID\nrow1 a|aa|aaa b Id1|Id2\nrow2 A B Id3|a\nrow2 a b id3\n")
    got = {r.value: r.target for r in joins.index(t, "ValueB").collect()}
    assert got["row1"] == "b" and got["a"] == "b" and got["aaa"] == "b" and got["A"] == "B" and got["B"] == "B"
    only = {r.value: r.target for r in joins.index(t, "ValueB", ["OtherID"]).collect()}
    assert only["a"] == "B" and "B" not in only


def test_paste(spark):
    a = table(spark, "#Row LabelA LabelB LabelC\nrow1 A B C\nrow2 AA BB CC\n", shape="list")
    b = table(spark, "#Row Labela Labelb\nrow1 a b\n", shape="list")
    c = table(spark, "#Row Labelc\nrow3 ccc\n", shape="list")
    got = rows(joins.paste([a, b, c]))
    assert got["row2"] == ("AA", "BB", "CC", "", "", "") and got["row3"] == ("", "", "", "", "", "ccc")
    assert set(rows(joins.paste([a, b], all_match=True))) == {"row1"}
    same = rows(joins.paste([table(spark, "#Row L\nrow2 AA\n"), table(spark, "#Row L\nrow2 AAA\nrow3 x\n")], same_fields=True, one2one=False))
    assert same == {"row2": (["AA", "AAA"],), "row3": (["x"],)}


def files(spark):
    return [table(spark, b) for b in ("#A B C\na b c\naa bb cc\n", "#Y Z A\ny z a\nyy zz aa\n", "#Y X\ny x\nyy xx\n")]


def test_translation(spark):
    got = lambda a, b: {r.value: r.target for r in translate.translation_index(files(spark), a, b).collect()}
    assert got("A", "X") == {"a": "x", "aa": "xx"} and got("C", "Y")["c"] == "y" and got("X", "A")["x"] == "a" and got(None, "B")["cc"] == "bb"
    schemas = [["A", "B", "C"], ["Y", "Z", "A"], ["Y", "X"], ["X", "R"], ["A", "R"]]
    assert [translate.path(schemas, *p) for p in (("C", "A"), ("B", "Y"), ("B", "X"), ("B", "R"))] == [[0], [0, 1], [0, 1, 2], [0, 4]]
    with pytest.raises(translate.NoPath):
        translate.path(schemas[:2], "B", "R")


def test_translate_tables(spark):
    t = table(spark, "#A V\na 1\naa 2\nzz 3\n")
    assert rows(translate.translate(t, "A", "X", files(spark))) == {"x": (["1"],), "xx": (["2"],)}
    assert "zz" in rows(translate.translate(t, "A", "X", files(spark), keep_unresolved=True))
    lists = table(spark, "#K A\nk zz|aa|a\n")
    assert rows(translate.translate(lists, "A", "X", files(spark)))["k"] == (["xx", "x"],)


RULER = [("a", 3, 8), ("b", 1, 6), ("c", 4, 10), ("d", 2, 5), ("e", 4, 9), ("f", 13, 15), ("g", 9, 12)]


def test_range_queries(spark):
    df = spark.createDataFrame(RULER, "key string, start long, end long")
    at = lambda *q: {r.key for r in ranges.query(df, *q).collect()}
    assert at(0) == set() and at(1) == {"b"} and at(3) == {"a", "b", "d"} and at(3, 4) == set("abcde") and at(20, 100) == set()
    assert ranges.describe(ranges.query(df, 1), True).first()[0] == "1:6:b"
    t = table(spark, "#K Pos1 Pos2\nrow1 0|10 10|30\nrow2 30 35\n")
    spans = ranges.intervals(t, "Pos1", "Pos2")
    assert {r.key for r in ranges.query(spans, 20).collect()} == {"row1"}


@pytest.mark.parametrize("width", [1, 7, 100])
def test_range_join_is_brute_force(spark, width):
    rng = random.Random(width)
    span = lambda: (s := rng.randrange(-10**4, 10**6), s + int(10 ** rng.uniform(0, 7)))
    a, b = [(i, *span()) for i in range(150)], [(i, *span()) for i in range(150)]
    found = ranges.overlaps(spark.createDataFrame(a, "k long, start long, end long"), spark.createDataFrame(b, "q long, q_start long, q_end long"), width)
    assert "CartesianProduct" not in found._jdf.queryExecution().toString() and "NestedLoop" not in found._jdf.queryExecution().toString()
    assert sorted((r.k, r.q) for r in found.collect()) == sorted((x[0], y[0]) for x in a for y in b if x[1] <= y[2] and x[2] >= y[1])


PEOPLE = {
    "identifiers": ("#Name,Alias,ID\nMiguel,Miki,001\nIsabel,Isa,002\nDomingo,Juan,003\nMaria,Mariluz,004\nClara,Clei,005\nGuillermo,Guille,006\nGuillermina,Mari,007\nGloria,Gloria,008\n", "list"),
    "brothers": ("#Older (Alias),Younger (Alias)\nClei,Guille\nIsa,Miki\n", "list"),
    "parents": ("#Child (Alias),Parent (Alias),Type of parent\nMiki,Juan|Mariluz,father|mother\nClei,Juan|Gloria,father|mother\n", "double"),
}


@pytest.fixture
def kb(spark):
    t = {k: text.from_text(spark, body, sep=",", shape=shape) for k, (body, shape) in PEOPLE.items()}
    kb = KnowledgeBase(spark, "family")
    kb.register("brothers", t["brothers"], [t["identifiers"]], undirected=True, description="Siblings")
    kb.register("parents", lambda: t["parents"], [t["identifiers"]])
    return kb


def pairs(e):
    return {(r.source, r.target) for r in e.collect()}


def test_field_specs():
    assert graph.field_spec("A=~B=>C") == ("A", "B", "C") and graph.field_spec("A=>C") == ("A", None, "C") and graph.field_spec("=~B") == (None, "B", None) and graph.field_spec(None) == (None, None, None)


def test_edges(kb, spark):
    assert pairs(kb.index("brothers")) == {("Clei", "Guille"), ("Guille", "Clei"), ("Isa", "Miki"), ("Miki", "Isa")}
    e = kb.index("parents")
    assert pairs(e) == {("Miki", "Juan"), ("Miki", "Mariluz"), ("Clei", "Juan"), ("Clei", "Gloria")}
    from quillon.operators.filters import edge_filter

    assert pairs(edge_filter(e, "Type of parent", "mother")) == {("Miki", "Mariluz"), ("Clei", "Gloria")}
    ids = text.from_text(spark, PEOPLE["identifiers"][0], sep=",", shape="list")
    named = graph.edges(kb.table("parents"), "Child=~Alias=>Name", "Parent=~Alias=>Name", identifiers=[ids])
    assert ("Miguel", "Domingo") in pairs(named)
    assert pairs(kb.parents("parents", "Juan")) == {("Miki", "Juan"), ("Clei", "Juan")} and pairs(kb.query("parents", "Miki~")) == {("Miki", "Juan"), ("Miki", "Mariluz")}


def entities(a, v):
    return {r.entity for r in a.assignments[v].collect()}


def test_traverse(kb):
    assert entities(kb.traverse(["Miki brothers ?1"]), "?1") == {"Isa"}
    assert entities(kb.traverse(["001 parents ?1 - 'Type of parent=father'"]), "?1") == {"Juan"}
    two = kb.traverse("?1 parents Domingo\n?1 brothers ?2")
    assert {tuple(r) for r in two.paths.select("?1", "?2").collect()} == {("Clei", "Guille"), ("Miki", "Isa")}
    assert entities(kb.traverse("?target =brothers 001\n?1 brothers ?target"), "?1") == {"Isa"}
    kb.save_list("some", ["Clei"])
    assert entities(kb.traverse(":some parents ?p\n?c parents ?p"), "?c") == {"Clei", "Miki"}
    block = kb.traverse("?x{\n?x brothers Miki\n}\n?x brothers ?y")
    assert entities(block, "?y") == {"Miki"} and block.paths.count() == 1
    none = kb.traverse("nobody parents ?1\n?1 brothers ?2")
    assert none.paths.count() == 0
    either = kb.traverse("Miki ?db ?1")
    assert {tuple(r) for r in either.paths.select("?db", "?1").collect()} == {("brothers", "Isa"), ("parents", "Juan"), ("parents", "Mariluz")}
    assert "Siblings" in kb.describe() and kb.info("brothers")["undirected"]


def test_join_in_cells_is_the_join(spark):
    left = spark.createDataFrame([("a" if i % 5 else "b", i // 2, 0) for i in range(60)] + [(None, 1, 0), ("c", 1, 0)], "k string, l int, n int")
    right = spark.createDataFrame([("a" if i % 3 else "b", i // 2) for i in range(40)] + [(None, 1), ("d", 1)], "k string, r int")
    pairs_of = lambda df: sorted(map(tuple, df.collect()))
    counts = left.groupBy("k").agg(F.count("*").alias("__n"))
    for found in (joins.join_in_cells(left, right, ["k"], rows_per_cell=7), joins.join_in_cells(left, right, ["k"], counts, 7), joins.join_in_cells(left, right, ["k"])):
        assert pairs_of(found) == pairs_of(left.join(right, "k"))
    assert pairs_of(joins.join_in_cells(left, right.select("k"), ["k"], rows_per_cell=7)) == pairs_of(left.join(right.select("k"), "k"))


def trade(spark, customers=4000, nations=2):
    """Customers and suppliers of a few nations, nation 0 in region 0 and the others in region 1."""
    kb = KnowledgeBase(spark, "trade")
    numbered = lambda n: spark.range(n).select(F.concat(F.lit("e"), "id").alias("a"), (F.col("id") % nations).cast("string").alias("b"))
    for name, df in (("lives_in", numbered(customers)), ("ships_from", numbered(30)), ("part_of", spark.range(nations).selectExpr("string(id) as a", "if(id = 0, '0', '1') as b"))):
        kb.register(name, keyed(df, "a", shape="list"), source="a", target="b")
    return kb


def test_paths_of_one_entity_are_shared_out(spark):
    """All paths of a group of rules that meet in one entity are more than a task should make."""
    found = trade(spark, nations=1).traverse("?s ships_from ?n\n?c lives_in ?n").paths
    assert found.distinct().count() == found.count() == 4000 * 30
    shares = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert len(shares) > 1 and max(shares) < 4000 * 30


def test_paths_along_a_chain_of_rules(spark):
    kb = trade(spark, customers=2500)
    found = kb.traverse("?s ships_from ?n\n?c lives_in ?n\n?n part_of ?r\n?m part_of ?r").paths
    assert sorted(map(tuple, found.groupBy("?n", "?r", "?m").count().collect())) == [(n, n, n, 1250 * 15) for n in "01"]


def test_only_what_all_rules_allow_is_joined(spark, monkeypatch):
    """A condition on the entity in which two rules meet holds before these are joined."""
    sides, join = [], knowledge.join_in_cells
    monkeypatch.setattr(knowledge, "join_in_cells", lambda left, right, *a: sides.append((left.count(), right.count())) or join(left, right, *a))
    found = trade(spark, customers=40).traverse("?s ships_from ?n\n?c lives_in ?n\n?n part_of 0").paths
    assert found.count() == 20 * 15 and sides == [(20, 15)]


def test_subset_reports_a_pair_once(kb):
    assert pairs(kb.subset("brothers", ["Isa", "Miki"])) == {("Miki", "Isa")}


def test_entity_properties(spark):
    e, calls = Entity("Person"), spark.sparkContext.accumulator(0)

    @e.property("loud")
    def loud(c):
        return F.upper(c)

    @e.property("size", "multiple", "long")
    def size(s):
        calls.add(len(s))
        return s.str.len()

    df = typed(spark.createDataFrame([("ab",), ("abc",), ("ab",)], "name string"), "name", "Person")
    assert entity_of(df, "name") == "Person"
    assert [r.loud for r in e.with_property(df, "name", "loud").collect()] == ["AB", "ABC", "AB"]
    assert sorted(r.size for r in e.with_property(df, "name", "size").collect()) == [2, 2, 3] and calls.value == 2
    more = df.union(spark.createDataFrame([("abcd",)], "name string"))
    assert sorted(r.size for r in e.with_property(more, "name", "size").collect()) == [2, 2, 3, 4] and calls.value == 3
    e.forget("size")


def test_annotations(spark):
    df = spark.createDataFrame([("x", "1", ["a", "b"]), ("y", None, [])], "id string, code string, tags array<string>")
    back = from_annotation_table(annotation_table(df, "id", ["code"], ["tags"]), "code string", ["tags"])
    assert {tuple(map(str, r)) for r in back.collect()} == {("x", "1", "['a', 'b']"), ("y", "None", "[]")}


def test_workflow(spark):
    w, made = Workflow("test"), []

    @w.task(inputs=[Input("n", int, 3), Input("need", str, required=True)])
    def numbers(spark, inputs):
        made.append(inputs["n"])
        return spark.range(inputs["n"])

    @w.task(deps=["numbers"])
    def total(spark, inputs, df):
        return df.groupBy().sum("id").first()[0]

    @w.task(deps=[("numbers", {"need": "x"})])
    def broken(spark, inputs, df):
        raise RuntimeError("no")

    @w.task(deps=["total", "broken"], may_fail=["broken"])
    def either(spark, inputs, n, nothing):
        return [n, nothing]

    folder = store.work_path(spark, "wf")
    with pytest.raises(MissingInput):
        w.job(spark, folder, "total")
    job = w.job(spark, folder, "total", need="x", n="4")
    assert job.run() == 6 and job.done and made == [4]
    again = w.job(spark, folder, "total", need="x", n=4)
    assert again.digest == job.digest and again.run() == 6 and made == [4]
    assert w.job(spark, folder, "total", need="y", n=4).digest != job.digest
    time.sleep(0.01)
    again.step("numbers").clean()
    assert again.run() == 6 and made == [4, 4] and "numbers" in again.provenance()
    assert job.trace().count() == 2
    with pytest.raises(Failed):
        w.job(spark, folder, "broken").run()
    assert w.job(spark, folder, "broken").status == "error"
    assert w.job(spark, folder, "either", need="x", n=4).run(parallel=2) == [6, None]
    assert w.from_json(spark, folder, job.to_json()).digest == job.digest


def test_streams(spark):
    folder, events = store.work_path(spark, "in"), []
    spark.createDataFrame([("k1\ta|b",), ("#c\tx",), ("k2\tz",)], "value string").coalesce(1).write.text(folder)
    other = table(spark, "#K W\nk1 w\n", shape="list")
    stream = streams.attach_static(streams.stream_lines(spark, folder, ["K", "V"], sep2="|"), "K", other)
    q = stream.writeStream.foreachBatch(lambda df, _: events.extend(df.collect())).trigger(availableNow=True).option("checkpointLocation", store.work_path(spark, "cp")).start()
    q.awaitTermination()
    assert sorted((r.K, r.V, r.W) for r in events) == [("k1", ["a", "b"], "w"), ("k2", ["z"], None)]
