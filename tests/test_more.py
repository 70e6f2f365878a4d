import random

import pytest
from pyspark.sql import functions as F

from quillon.model import ORD, in_namespace, keyed
from quillon.operators import aggregate, filters, joins, ranges, reshape, sets, sorting, translate
from quillon.operators.entity import Entity
from quillon.operators.entity_workflow import EntityWorkflow
from quillon.operators.knowledge import KnowledgeBase, open_knowledge
from quillon.sources import store, text
from quillon.streaming import tables as streams

WS = "#: :sep=/\\s+/\n"


def cells(t, *fields):
    return {r[t.key]: [list(r[f]) if t.listed else r[f] for f in fields or t.fields] for r in t.df.collect()}


def test_rows_of_a_repeated_key_keep_their_own_matches(spark):
    df = spark.createDataFrame([("r", ["x"], 0), ("r", ["y", "z"], 1), ("s", [], 2)], f"k string, v array<string>, {ORD} long")
    t = keyed(df, "k", ["v"], "double")
    other = text.from_text(spark, "#ID\tName\nx\tX\ny\tY", shape="list")
    got = joins.attach(t, other, ["Name"], match_key="v", other_key="ID")
    assert sorted((r.k, list(r.v), list(r.Name)) for r in got.df.collect()) == [("r", ["x"], ["X"]), ("r", ["y", "z"], ["Y"]), ("s", [], [])]
    named = translate.translate(t, "v", "Name", [text.from_text(spark, "#v\tName\nx\tX\ny\tY", shape="list")])
    assert sorted(tuple(r.Name) for r in named.df.collect()) == [(), ("X",), ("Y",)]


def test_attach_through_identifiers(spark):
    one = text.from_text(spark, WS + "#Id    ValueA\nrow1    a|aa|aaa\nrow2    A")
    two = text.from_text(spark, WS + "#Id2    ValueB\nROW_1    b\nROW_2    C")
    ids = text.from_text(spark, WS + "#Id    Id2\nrow1    ROW_1\nrow2    ROW_2\nrow3    ROW_3")
    assert cells(joins.attach(one.identified_by(ids), two, ["ValueB"]))["row2"] == [["A"], ["C"]]
    assert cells(joins.attach(one, two.identified_by(ids), ["ValueB"]))["row1"] == [["a", "aa", "aaa"], ["b"]]
    with pytest.raises(KeyError):
        joins.attach(one, two)


def test_fixed_and_stopped_lines(spark, tmp_path):
    path = tmp_path / "lines"
    path.write_text(WS.replace("\n", "#:type=:single\n") + "#Id Value\na 1\nb 2\nend 0\nc 4\n")
    change = lambda v: F.when(v.contains("1"), "a 3").when(~v.startswith("b"), v)
    t = text.read_tsv(spark, f"file://{path}", key_field="Value", fix=change, stop=lambda v: v.startswith("end"))
    assert {r["Value"] for r in t.df.collect()} == {"3"}
    assert text.read_tsv(spark, f"file://{path}", fix=True).df.count() == 4


def test_long_headers_and_long_rows(spark, tmp_path):
    path, cells_ = tmp_path / "long", 1_048_580
    path.write_text("".join(f"#comment {i}\n" for i in range(300)) + "#Id\tV\n" + "a\t1\n")
    t = text.read_tsv(spark, f"file://{path}", shape="list")
    assert t.all_fields == ("Id", "V") and [tuple(r) for r in t.public().collect()] == [("a", "1")]
    lines = spark.createDataFrame([("k\t" + "\t".join(["x"] * cells_), 0)], f"value string, {ORD} long")
    flat = text.parse_lines(lines, text.Header("Id", ["V"], {"type": "flat"}), shape="flat")
    assert flat.df.select(F.size("V")).first()[0] == cells_


def test_sibling_identifiers(spark, tmp_path):
    ids = text.from_text(spark, "#Id\tId2\nr\tR")
    (tmp_path / "table").write_text("#Id\tV\nr\t1\n")
    assert text.read_tsv(spark, f"file://{tmp_path}/table", identifiers=True).meta.identifiers == ()
    (tmp_path / "identifiers").write_text("#Id\tId2\nr\tR\n")
    t = text.read_tsv(spark, f"file://{tmp_path}/table", identifiers=True)
    assert [i.all_fields for i in t.meta.identifiers] == [ids.all_fields]
    assert in_namespace("a/[NAMESPACE]/b/NAMESPACE", "Hsa") == "a/Hsa/b/Hsa" and in_namespace("NAMESPACE", None) == "NAMESPACE"


def test_zip_new_and_named_rows(spark):
    t = text.from_text(spark, WS + "#Id A B\nr1 a b\nr2 c d")
    more = text.from_text(spark, WS + "#Id A B\nr1 x y\nr3 z w")
    assert cells(sets.zip_new(t, more)) == {"r1": [["a", "x"], ["b", "y"]], "r2": [["c"], ["d"]], "r3": [["z"], ["w"]]}
    names = spark.createDataFrame([("a", "Alpha"), ("d", "Delta")], "value string, target string")
    assert set(cells(filters.select_named(t, "A", "Alpha", names))) == {"r1"}
    assert set(cells(filters.select_named(t, "B", __import__("re").compile("^D"), names))) == {"r2"}
    assert set(cells(filters.select_named(t, "A", "Alpha", names, invert=True))) == {"r2"}
    rows = reshape.traverse(t, lambda c: F.when(c["Id"] == "r1", F.concat("A", "B")), many=True)
    assert [tuple(r) for r in rows.orderBy("result").collect()] == [("r1", "a"), ("r1", "b")]


def test_positions_of_sorted_rows(spark):
    df = spark.createDataFrame([(i * 7919 % 1000,) for i in range(1000)], "v long").repartition(7)
    found = sorting.numbered(df.orderBy(F.desc("v"))).collect()
    assert sorted((r.v, r.position) for r in found) == [(i, 1000 - i) for i in range(1000)]
    assert sorting.numbered(df.limit(0)).count() == 0


@pytest.mark.parametrize("rows_per_bin", [10**6, 3])
def test_overlaps_brute_force(spark, rows_per_bin):
    rng = random.Random(1)
    length = lambda: rng.choice([0, 1, 5, 40, 3000, 10**6, 10**9])
    some = lambda n: [(i, s, s + rng.randrange(length() + 1)) for i in range(n) for s in [rng.randrange(-5000, 5000)]]
    a, b = some(150), some(60)
    left = spark.createDataFrame([*a, (999, 5, 4)], "key long, start long, end long")
    right = spark.createDataFrame(b, "q long, q_start long, q_end long")
    got = sorted((r.key, r.q) for r in ranges.overlaps(left, right, 4, rows_per_bin=rows_per_bin).collect())
    assert got == sorted((i, j) for i, s, e in a for j, u, v in b if s <= v and e >= u)
    assert ranges.overlaps(left.limit(0), right, 4).count() == 0 == ranges.overlaps(left, right.limit(0), 4).count()


def test_collapsed_ranges(spark):
    rows = [("a", 1, 3), ("a", 2, 9), ("a", 4, 5), ("a", 10, 11), ("a", 13, 14), ("b", 2, 2)]
    got = ranges.collapse(spark.createDataFrame(rows, "who string, start long, end long"), "who").collect()
    assert sorted((r.who, r.start, r.end) for r in got) == [("a", 1, 11), ("a", 13, 14), ("b", 2, 2)]


def test_a_full_bin_is_split_however_far_the_others_lie(spark):
    rows = [(n, 5, 6) for n in range(900)] + [(900, 10**9, 10**9)]
    left = ranges._shown(spark.createDataFrame(rows, "key long, start long, end long"), ("start", "end"), 10, [(0, 0, F.lit(True))])
    assert [(r["__bin"], r["__parts"]) for r in ranges._parts(left, 100).collect()] == [(0, 9)]
    df = spark.createDataFrame(rows, "key long, start long, end long")
    asked = spark.createDataFrame([(1, 0, 5), (2, 6, 10**9), (3, 7, 8)], "q long, q_start long, q_end long")
    got = ranges.overlaps(df, asked, 10, rows_per_bin=100)
    assert sorted((r.key, r.q) for r in got.collect()) == sorted((k, q) for k, s, e in rows for q, a, b in ((1, 0, 5), (2, 6, 10**9), (3, 7, 8)) if s <= b and e >= a)


def test_trace_times_over_slices(spark):
    rng = random.Random(2)
    jobs, at = [], 0
    for i in range(300):
        at += rng.choice([0, 1, 2, 50])
        jobs.append((i, f"g{i % 3}", at, at + rng.randrange(4)))
    df = spark.createDataFrame(jobs, "id long, g string, s long, e long").selectExpr("id", "g", "timestamp_seconds(s) as start", "timestamp_seconds(e) as end")

    def plain(rows):
        first, latest, gone, out = min(s for _, _, s, _ in rows), None, 0, {}
        for i, _, s, e in sorted(rows, key=lambda r: (r[2], r[3])):
            gone += max(0, s - latest) if latest is not None else 0
            latest = max(e, latest) if latest is not None else e
            out[i] = (s - first - gone, e - first - gone)
        return out

    assert {r.id: (r.start_s, r.end_s) for r in aggregate.trace_times(df).collect()} == plain(jobs)
    assert {r.id: (r.start_s, r.end_s) for r in aggregate.trace_times(df, rows_per_window=40).collect()} == plain(jobs)
    assert {r.id: (r.start_s, r.end_s) for r in aggregate.trace_times(df, "g", rows_per_window=40).collect()} == {r.id: (r.start_s, r.end_s) for r in aggregate.trace_times(df, "g").collect()}
    by = {r.id: (r.start_s, r.end_s) for r in aggregate.trace_times(df, "g").collect()}
    assert by == {k: v for g in ("g0", "g1", "g2") for k, v in plain([j for j in jobs if j[1] == g]).items()}
    assert aggregate.trace_times(df.limit(0)).count() == 0


def family(spark, **options):
    kb = KnowledgeBase(spark, "family", **options)
    kb.register("brothers", text.from_text(spark, "#Older\tYounger\nClei\tGuille\nIsa\tMiki", shape="list"))
    kb.register("parents", text.from_text(spark, "#Child\tParent\nMiki\tJuan|Mariluz"))
    return kb


def test_unconnected_rules_have_paths_of_their_own(spark):
    kb = family(spark)
    found = kb.traverse("?a brothers Miki\nMiki parents ?b")
    assert found.paths is None and [sorted(map(tuple, g.collect())) for g in found.groups] == [[("Isa",)], [("Juan",), ("Mariluz",)]]
    assert kb.traverse("?a brothers Miki\nMiki parents Juan").paths.count() == 1
    assert kb.traverse("?a brothers Miki\nMiki parents Isa").paths.count() == 0


def test_lists_and_knowledge_are_saved(spark, tmp_path):
    kb = family(spark, folder=f"file://{tmp_path}/kb")
    kb.save_list("some", ["Miki", "Isa"], "Person")
    kb.save_list("gone", ["Clei"])
    kb.delete_list("gone")
    assert kb.list_names() == ["some"]
    readme = "All of them.\n\n# Brothers\n\nSiblings.\n\n# Other\nno\n"
    assert kb.take_descriptions(readme) == "All of them." and kb.info("brothers")["description"] == "Siblings."
    kb.save(f"file://{tmp_path}/kb")
    back = open_knowledge(spark, f"file://{tmp_path}/kb")
    assert back.to_json() == kb.to_json()
    assert back.load_list("some").schema["entity"].metadata == {"entity": "Person"}
    assert {r.entity for r in back.traverse(":some parents ?p").assignments["?p"].collect()} == {"Juan", "Mariluz"}
    with pytest.raises(KeyError):
        back.load_list("gone")


def test_saved_filters(spark, tmp_path):
    t = text.from_text(spark, WS + "#Id A B\nr1 a b\nr2 a d\nr3 c d")
    stack = filters.FilterStack(t, f"file://{tmp_path}/f").add("field:A", "a")
    with stack.having("field:B", "d") as both:
        assert set(cells(both)) == {"r2"}
    assert set(cells(stack.result())) == {"r1", "r2"} and len(list((tmp_path / "f").iterdir())) == 2
    stack.reset(saved=True)
    assert set(cells(stack.result())) == {"r1", "r2", "r3"} and not (tmp_path / "f").exists()


def test_tasks_of_entities(spark, tmp_path):
    w, calls = EntityWorkflow(Entity("Person"), f"file://{tmp_path}"), []

    @w.task(alias="hello")
    def hi(name, greeting="Hi"):
        calls.append(1)
        return F.concat(F.lit(f"{greeting} "), name)

    @w.task("list")
    def group(names):
        return names.agg(F.array_join(F.array_sort(F.collect_list("entity")), "; ").alias("all"))

    df = spark.createDataFrame([("Miki", 1), ("Clei", 2), ("Miki", 3), (None, 4)], "who string, n long")
    for _ in range(2):
        found = w.with_property(df, "who", "hello", "said").orderBy("n").collect()
        assert [r.said for r in found] == ["Hi Miki", "Hi Clei", "Hi Miki", None]
    assert len(calls) == 1
    assert w.of_list(["Miki", "Clei"], "group").first()[0] == "Clei; Miki"
    with pytest.raises(ValueError):
        w.with_property(df, "who", "group")


def test_work_folder_must_be_shared_on_a_cluster():
    assert store._own_folder("local[4]").startswith("file://")
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            store._own_folder(master)


def test_streams_are_pasted_by_key_and_time(spark, tmp_path):
    for name, rows in (("a", ["k1\t2024-01-01 00:00:00\tx", "k2\t2024-01-01 00:00:00\ty", "k1\t2024-01-05 00:00:00\tlate"]), ("b", ["k1\t2024-01-01 00:10:00\tX", "k2\t2024-01-02 00:00:00\tY", "k9\t2024-01-05 00:00:00\tZ"])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "lines").write_text("\n".join(rows) + "\n")
    side = lambda n: streams.stream_lines(spark, f"file://{tmp_path}/{n}", ["k", "at", n]).withColumn("at", F.col("at").cast("timestamp"))
    pasted = streams.paste_streams(side("a"), side("b"), "k", "at", "1 hour", "1 hour").select("k", "a", "b")
    pasted.writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start(f"file://{tmp_path}/out").awaitTermination()
    got = sorted(map(tuple, spark.read.schema(pasted.schema).parquet(f"file://{tmp_path}/out").collect()), key=str)
    assert ("k1", "x", "X") in got and ("k2", "y", None) in got
