"""Further queries over the given tables, each with its DuckDB SQL beside it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cells import join_cell
from ..model import ORD, keyed
from ..operators import aggregate, filters, graph, joins, ranges, reshape, sets, sorting
from ..operators.entity import Entity, annotation_table, from_annotation_table, kept_annotations, typed
from ..operators.entity_workflow import EntityWorkflow
from ..operators.knowledge import KnowledgeBase, open_knowledge
from ..operators.workflow import Input, Workflow
from ..sources import store, text
from ..streaming import tables as streams
from .oracles import JOBS, LINES, OBC, OBC_SHOWN, PARTS, SPANS
from .queries import customer_nation, customers, jobs, knowledge, lines_by_order, nations, order_spans, orders, orders_by_customer, parts, regions, shown, suppliers, table, totals_workflow

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


# Sources


def dumped(spark: SparkSession, t, **options) -> str:
    path = store.work_path(spark, "tsv")
    text.write_tsv(t, path, **options)
    return path


@query("select p_partkey::varchar as p_partkey, p_name, replace(p_brand, 'Brand#1', 'B1-') as p_brand, p_type, p_size::varchar as p_size from part where p_brand not like 'Brand#2%'")
def tsv_fixed(spark, sf):
    """Lines are repaired as they are read, and some of them dropped."""
    path = dumped(spark, parts(spark, sf))
    lines = text.fix_lines(text.read_lines(spark, f"{path}/part-*"), lambda line: F.when(~line.contains("Brand#2"), F.replace(line, F.lit("Brand#1"), F.lit("B1-"))))
    return shown(text.parse_lines(lines, text.parse_header(text.header_lines(parts(spark, sf))), shape="list"))


@query("select c_custkey::varchar as c_custkey, c_mktsegment from customer where c_mktsegment in ('BUILDING', 'MACHINERY')")
def tsv_grep(spark, sf):
    path = dumped(spark, reshape.slice_fields(customers(spark, sf), ["c_mktsegment"]))
    return shown(text.read_tsv(spark, path, grep="BUILDING|MACHINERY", shape="list"))


@query("select c_custkey::varchar as c_custkey, c_mktsegment from customer order by customer.c_custkey::varchar limit 30")
def tsv_head(spark, sf):
    t = reshape.slice_fields(customers(spark, sf), ["c_mktsegment"])
    path = dumped(spark, t.with_df(t.df.orderBy("c_custkey")))
    return shown(text.read_tsv(spark, path, head=30, shape="list"))


@query("select upper(concat_ws(chr(9), p_partkey::varchar, p_name, p_brand, p_type, p_size::varchar)) as value, '#p_partkey|p_name|p_brand|p_type|p_size' as header from part")
def tsv_processed(spark, sf):
    """The body of a file changed, its header as it was."""
    head, body = text.process_body(spark, dumped(spark, parts(spark, sf)), F.upper)
    return body.select("value", F.lit(head[-1].replace("\t", "|")).alias("header"))


@query("select n_nationkey::varchar as n_nationkey, n_name, label from nation left join (values (0, 'south'), (1, 'west'), (2, 'east')) v(r, label) on n_regionkey = r")
def spec_table(spark, sf):
    labels = text.from_spec(spark, {"0": ["south"], "1": ["west"], "2": ["east"]}, "n_regionkey~label#:type=:list")
    t = joins.attach(nations(spark, sf), labels, ["label"], match_key="n_regionkey")
    return shown(reshape.slice_fields(t, ["n_name", "label"]))


@query("select s_suppkey::varchar as supplier, s_name, n_regionkey::varchar as region from supplier join nation on s_nationkey = n_nationkey")
def attach_identified(spark, sf):
    """No common name: the rows meet through the mapping table that lies beside the file."""
    folder = store.work_path(spark, "folder")
    mapping = joins.attach(suppliers(spark, sf), nations(spark, sf), ["n_name"], match_key="s_nationkey", other_key="n_nationkey")
    text.write_tsv(reshape.rename(reshape.slice_fields(mapping, ["n_name"]), {"s_suppkey": "supplier", "n_name": "nation"}), f"{folder}/identifiers")
    text.write_tsv(reshape.rename(reshape.slice_fields(suppliers(spark, sf), ["s_name"]), {"s_suppkey": "supplier"}), f"{folder}/suppliers")
    t = text.read_dump(spark, f"{folder}/suppliers").identified_by(*text.sibling_identifiers(spark, f"{folder}/suppliers"))
    other = reshape.slice_fields(reshape.rename(reshape.change_key(nations(spark, sf), "n_name"), {"n_name": "nation", "n_regionkey": "region"}), ["region"])
    return shown(joins.attach(t, other))


@query(f"with {LINES} select k as l_orderkey, string_agg(p, '|' order by i) as l_partkey, string_agg(f, '|' order by i) as l_returnflag, string_agg(s, '|' order by i) as l_linestatus from ln where k like '12%' group by k")
def store_import(spark, sf):
    """Text straight into a store, sorted by key, and a prefix of it."""
    path = store.work_path(spark, "store")
    store.save(text.read_dump(spark, dumped(spark, lines_by_order(spark, sf))), path, sorted_by_key=True)
    return shown(filters.prefix(store.load(spark, path), "12"))


@query("select p as position, n_name from (values (3::bigint), (7), (25), (1000)) v(p) left join nation on n_nationkey = p - 1")
def packed_by_function(spark, sf):
    t = reshape.slice_fields(nations(spark, sf), ["n_name"])
    return store.at_positions(store.packed(t, F.col("n_nationkey").cast("bigint") + 1), [3, 7, 25, 1000])


@query(f"with {OBC}, s as (select c_custkey::varchar as k, c_mktsegment as m, c_nationkey::varchar as n from customer where c_nationkey < 10) select coalesce(k, o_custkey) as o_custkey, coalesce(m, array_to_string(ks, '|')) as o_orderkey, coalesce(n, array_to_string(ss, '|')) as o_orderstatus from obc full join s on o_custkey = k")
def upserted(spark, sf):
    """Rows put over those of the same key."""
    new = keyed(table(spark, sf, "customer").filter("c_nationkey < 10").select(F.col("c_custkey").cast("string").alias("o_custkey"), "c_mktsegment", F.col("c_nationkey").cast("string").alias("n")), "o_custkey", shape="list")
    t = reshape.slice_fields(orders_by_customer(spark, sf), ["o_orderkey", "o_orderstatus"])
    return shown(store.upsert(t, reshape.to_shape(new, "double")))


# Selection


@query(f"with t as ({PARTS}) select * from t where 'Brand#12' in (p_partkey, p_name, p_brand, p_type, p_size)")
def select_anywhere(spark, sf):
    return shown(filters.select(parts(spark, sf), "Brand#12"))


@query("select c_custkey::varchar as c_custkey, c_name, c_nationkey::varchar as c_nationkey, c_mktsegment, c_acctbal::varchar as c_acctbal from customer where c_nationkey > 20")
def select_by_function(spark, sf):
    t = filters.select_value(customers(spark, sf), "c_nationkey", lambda v: v.cast("int") > 20)
    return shown(t)


@query(OBC_SHOWN + " where len([p for p in ps if regexp_matches(p, '^[12]-')]) > 0")
def select_field_pattern(spark, sf):
    return shown(filters.select(orders_by_customer(spark, sf), {"o_orderpriority": re.compile("^[12]-")}))


@query("select c_custkey::varchar as c_custkey, c_name from customer join nation on c_nationkey = n_nationkey where regexp_matches(n_name, '[02468]$') ")
def select_named(spark, sf):
    """Rows whose nation's name matches, though they hold its number."""
    names = joins.index(nations(spark, sf), "n_name", [":key"])
    return shown(reshape.slice_fields(filters.select_named(customers(spark, sf), "c_nationkey", re.compile("[02468]$"), names), ["c_name"]))


@query(f"with {LINES} select k as l_orderkey, string_agg(p, '|' order by i) as l_partkey from ln group by k having bool_or(f = 'R') and bool_or(s = 'O') and not bool_or(f = 'A')")
def filter_stack_saved(spark, sf):
    """Two filters whose keys are saved, read by a second stack; a third one is laid on top."""
    folder, t = store.work_path(spark, "filters"), lines_by_order(spark, sf)
    filters.FilterStack(t, folder).add("field:l_returnflag", "R").add("field:l_linestatus", "O")
    again = filters.FilterStack(t, folder).add("field:l_returnflag", "R").add("field:l_linestatus", "O").result()
    return shown(reshape.slice_fields(filters.select(again, {"l_returnflag": "A"}, invert=True), ["l_partkey"]))


# Re-keying and rows


@query("select o_orderkey::varchar as o_orderkey, o_orderstatus from orders")
def reorder_list(spark, sf):
    """Element i of the cells goes with element i of the new key."""
    return shown(reshape.reorder(orders_by_customer(spark, sf), "o_orderkey", ["o_orderstatus"], one2one=False, shape="list"))


@query("with d as (select o_custkey, o_orderpriority as p, row_number() over (partition by o_custkey, o_orderpriority order by o_orderkey) as nth from orders) select p as o_orderpriority, string_agg(o_custkey::varchar, '|' order by o_custkey::varchar) as customers from d where nth = 1 group by p")
def reorder_uniq(spark, sf):
    t = reshape.reorder(orders_by_customer(spark, sf), "o_orderpriority", ["o_custkey"], one2one=False, uniq=True)
    return t.df.select("o_orderpriority", F.array_join(F.array_sort("o_custkey"), "|").alias("customers"))


@query("select n_name, n_nationkey::varchar as n_nationkey, n_regionkey::varchar as n_regionkey from nation")
def reorder_all_fields(spark, sf):
    t = reshape.reorder(nations(spark, sf), "n_name", "all")
    return t.df.select(F.col(t.key).alias("n_name"), "n_nationkey", "n_regionkey")


@query("select c_custkey::varchar as c_custkey, unnest(string_split(c_name, '#')) as piece from customer where c_acctbal > 0")
def traverse_rows(spark, sf):
    """A function that gives several results for a row, or none."""
    make = lambda c: F.when(c["c_acctbal"].cast("double") > 0, F.split(c["c_name"], "#"))
    return reshape.traverse(customers(spark, sf), make, "piece", many=True)


@query("select o_custkey::varchar as o_custkey, string_agg(o_orderkey::varchar, '|' order by o_orderkey) || coalesce('|' || any_value(c_mktsegment), '') as o_orderkey, string_agg(o_orderstatus, '|' order by o_orderkey) || case when any_value(c_mktsegment) is null then '' else '|' end as o_orderstatus from orders left join customer on c_custkey = o_custkey and c_nationkey < 5 group by o_custkey union all select c_custkey::varchar, c_mktsegment, '' from customer where c_nationkey < 5 and c_custkey not in (select o_custkey from orders)")
def zip_new(spark, sf):
    """New values behind the old ones of a key; a missing one is a place without text."""
    new = table(spark, sf, "customer").filter("c_nationkey < 5").select(F.col("c_custkey").cast("string").alias("o_custkey"), F.array("c_mktsegment").alias("a"), F.array().cast("array<string>").alias("b"))
    t = reshape.slice_fields(orders_by_customer(spark, sf), ["o_orderkey", "o_orderstatus"])
    return shown(sets.zip_new(t, keyed(new, "o_custkey", shape="double", order=F.lit(0).cast("bigint"))))


# Order


@query("select n_nationkey::varchar as n_nationkey, n_name, row_number() over (order by n_name desc, n_nationkey::varchar) as position from nation")
def sorted_positions(spark, sf):
    return sorting.numbered(sorting.sort_by(reshape.slice_fields(nations(spark, sf), ["n_name"]), "n_name", reverse=True))


@query("select c_custkey, c_acctbal, row_number() over (order by c_acctbal, c_custkey) as position from customer")
def sorted_customers(spark, sf):
    t = keyed(table(spark, sf, "customer"), "c_custkey", ["c_acctbal"], "list", "c_custkey")
    return sorting.numbered(sorting.sort_by(t, "c_acctbal"))


@query("select concat_ws(chr(9), s_suppkey::varchar, s_name) as value, row_number() over (order by supplier.s_suppkey::varchar) as position from supplier")
def dump_in_key_order(spark, sf):
    t = reshape.slice_fields(suppliers(spark, sf), ["s_name"])
    return sorting.numbered(text.dump_lines(t.with_df(t.df.orderBy("s_suppkey"))))


# Ranges


@query(
    f"""with {SPANS}, c as (select o_custkey as customer, start, "end" from spans join orders on o_orderkey = key),
g as (select *, case when start > max("end") over (partition by customer order by start, "end" rows between unbounded preceding and 1 preceding) + 1 then 1 else 0 end as new from c),
h as (select *, sum(new) over (partition by customer order by start, "end" rows unbounded preceding) as part from g)
select customer, min(start) as start, max("end") as "end" from h group by customer, part"""
)
def collapsed_spans(spark, sf):
    """The times in which a customer had an open order."""
    of = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("customer"))
    return ranges.collapse(order_spans(spark, sf).join(of, F.col("key") == F.col("o_orderkey")).select("customer", "start", "end"), "customer")


@query(
    f"""with {JOBS}, g as (select *, greatest(s - coalesce(max(e) over (order by s, e rows between unbounded preceding and 1 preceding), s), 0) as gap from jobs),
h as (select *, sum(gap) over (order by s, e rows between unbounded preceding and current row) as gone, min(s) over () as z from g)
select event_id, ((s - z - gone) / 1e6)::double as start_s, ((e - z - gone) / 1e6)::double as end_s from h"""
)
def trace_times_of_all(spark, sf):
    return aggregate.trace_times(jobs(spark, sf)).select("event_id", "start_s", "end_s")


# Relations and knowledge


@query("select 'lives_in' as relation, 'c_custkey' as source, 'c_nationkey' as target, 'c_mktsegment' as fields, count(*) as n from customer union all select 'part_of', 'n_nationkey', 'n_regionkey', 'n_name', count(*) from nation union all select 'ships_from', 's_suppkey', 's_nationkey', 's_name', count(*) from supplier")
def kb_registry(spark, sf):
    """What is registered, and how many edges each relation has."""
    kb, parts_ = knowledge(spark, sf), []
    for name in kb.relations:
        i = kb.info(name)
        parts_.append(kb.all(name).agg(F.count("*").alias("n")).select(F.lit(name).alias("relation"), F.lit(i["source"]).alias("source"), F.lit(i["target"]).alias("target"), F.lit("|".join(i["fields"])).alias("fields"), "n"))
    return parts_[0].unionByName(parts_[1]).unionByName(parts_[2])


@query("select c_custkey::varchar as source, c_nationkey::varchar as target, c_mktsegment from customer where c_nationkey in (select n_nationkey from nation where n_regionkey = 2) and c_acctbal < 0")
def kb_subset(spark, sf):
    """Edges between two sets of entities, both given as tables."""
    some = table(spark, sf, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").cast("string"))
    ends = table(spark, sf, "nation").filter("n_regionkey = 2").select(F.col("n_nationkey").cast("string"))
    return knowledge(spark, sf).subset("lives_in", some, ends)


@query("select c_custkey::varchar as source, c_nationkey::varchar as target, c_mktsegment from customer where customer.c_custkey::varchar like '13%'")
def edge_scan(spark, sf):
    """Edges by a prefix of their source."""
    return customer_nation(spark, sf).filter(F.startswith("source", F.lit("13")))


@query("select c_custkey::varchar as customer, c_nationkey::varchar as nation from customer where c_nationkey in (select s_nationkey from supplier where s_acctbal > 5000)")
def kb_saved(spark, sf):
    """A knowledge base is saved with a list and opened again; the list is a term of the query."""
    folder, kb = store.work_path(spark, "knowledge"), knowledge(spark, sf)
    kb.save_list("rich", table(spark, sf, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").cast("string")).distinct(), "Nation")
    kb.save(folder)
    found = open_knowledge(spark, folder).traverse("?n = :rich\n?customer lives_in ?n")
    return found.paths.select(F.col("?customer").alias("customer"), F.col("?n").alias("nation"))


@query("select s_suppkey::varchar as source, s_nationkey::varchar as target, 'Where suppliers ship from.' as description from supplier")
def kb_namespace(spark, sf):
    """A relation at a path with the namespace in it, described by a README."""
    root = store.work_path(spark, "namespaces")
    store.save(reshape.slice_fields(suppliers(spark, sf), ["s_nationkey"]), f"{root}/trade/suppliers")
    kb = KnowledgeBase(spark, "trade")
    kb.register("ships_from", f"{root}/[NAMESPACE]/suppliers")
    kb.take_descriptions("Trade.\n\n# Ships_from\n\nWhere suppliers ship from.\n")
    return kb.all("ships_from").select("source", "target", F.lit(kb.info("ships_from")["description"]).alias("description"))


# Entities and workflows


@query("select c_name, 'Customer ' || regexp_extract(c_name, '(\\d+)$', 1)::bigint as title, length(c_name) as size from customer")
def entity_tasks(spark, sf):
    """Tasks of a workflow as properties of entities, for each and for all at once."""
    w = EntityWorkflow(Entity("Customer"), store.work_path(spark, "jobs"))

    @w.task()
    def title(name, prefix="Customer"):
        return F.concat(F.lit(f"{prefix} "), F.regexp_extract(name, r"(\d+)$", 1).cast("bigint").cast("string"))

    @w.task("multiple")
    def size(names):
        return names.select("entity", F.length("entity").cast("bigint").alias("value"))

    df = typed(table(spark, sf, "customer").select("c_name"), "c_name", "Customer")
    return w.with_property(w.with_property(df, "c_name", "title"), "c_name", "size")


@query("select c_mktsegment as initial, count(*) as n from customer group by 1")
def entity_list_task(spark, sf):
    w = EntityWorkflow(Entity("Customer"), store.work_path(spark, "jobs"))
    segments = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"), "c_mktsegment")

    @w.task("list", [Input("column", str, "c_mktsegment")])
    def spread(ids, column):
        return ids.join(segments, F.col("entity") == F.col("id")).groupBy(F.col(column).alias("initial")).agg(F.count("*").alias("n"))

    w.of_list(segments, "spread")
    return w.of_list(segments, "spread")  # read, not made again


@query("select n_nationkey::varchar as id, n_name from nation where n_regionkey = 1")
def annotation_repo(spark, sf):
    """Tables of annotations that are made once, also those that are none."""
    folder, calls = store.work_path(spark, "annotations"), []

    def make() -> DataFrame:
        calls.append(1)
        return annotation_table(table(spark, sf, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").cast("string").alias("n_nationkey"), "n_name"), "n_nationkey", ["n_name"])

    kept_annotations(spark, folder, "some", make)
    assert kept_annotations(spark, folder, "none", lambda: None) is None and kept_annotations(spark, folder, "none", make) is None
    found = kept_annotations(spark, folder, "some", make)
    assert len(calls) == 1
    return from_annotation_table(found, "n_name string")


@query("select o_custkey, count(*) filter (o_orderstatus = 'O') as n, count(*) filter (o_orderstatus = 'P') as n_open from orders group by 1 having n > 0")
def workflow_from_inputs(spark, sf):
    """A job from its saved inputs is the same job, whose result is there already."""
    w, folder = totals_workflow(sf), store.work_path(spark, "jobs")
    first = w.job(spark, folder, "compared", status="O")
    first.run()
    again = w.from_json(spark, folder, first.to_json())
    assert again.digest == first.digest and again.done
    return again.run()


@query("select o_orderstatus, count(*) as n, 'none' as extra from orders group by 1")
def workflow_may_fail(spark, sf):
    """A dependency that may fail gives None; a cleaned job is made again."""
    w = Workflow("fallible")

    @w.task()
    def broken(spark):
        raise ValueError("no such table")

    def counted(spark, inputs, extra):
        return table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n")).withColumn("extra", F.lit("none" if extra is None else "some"))

    w.task(deps=["broken"], may_fail=["broken"])(counted)
    job = w.job(spark, store.work_path(spark, "jobs"), "counted")
    job.run()
    job.clean()
    assert job.status == "waiting"
    return job.run()


# Streams


def _run(stream: DataFrame, label: str) -> DataFrame:
    """All that a stream has now, written by it and read back."""
    spark = stream.sparkSession
    path = store.work_path(spark, label)
    stream.writeStream.format("parquet").option("checkpointLocation", f"{path}.state").trigger(availableNow=True).start(path).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def _stream(spark: SparkSession, t, names: list[str]) -> DataFrame:
    path = store.work_path(spark, "lines")
    text.dump_lines(t).write.text(path)
    return streams.stream_lines(spark, path, names)


@query("select c_custkey::varchar as c_custkey, c_mktsegment, n_name from customer left join nation on c_nationkey = n_nationkey and n_regionkey < 3")
def stream_attach(spark, sf):
    """New lines of a folder, joined with a table."""
    some = filters.select(nations(spark, sf), {"n_regionkey": ["0", "1", "2"]})
    lines = _stream(spark, reshape.slice_fields(customers(spark, sf), ["c_nationkey", "c_mktsegment"]), ["c_custkey", "c_nationkey", "c_mktsegment"])
    return _run(streams.attach_static(lines, "c_nationkey", reshape.slice_fields(some, ["n_name"])).select("c_custkey", "c_mktsegment", "n_name"), "attached")


@query("select c_custkey::varchar as id, c_name as name from customer union all select s_suppkey::varchar, s_name from supplier")
def stream_concat(spark, sf):
    a = _stream(spark, reshape.slice_fields(customers(spark, sf), ["c_name"]), ["k", "v"])
    b = _stream(spark, reshape.slice_fields(suppliers(spark, sf), ["s_name"]), ["key", "text"])
    return _run(streams.concat_streams([a, b], ["id", "name"]), "concatenated")


@query("select s_nationkey::varchar as nation, string_agg(s_name, '|' order by s_name) as names from supplier group by 1")
def stream_collapse(spark, sf):
    """Rows of a key as one, over all lines so far."""
    lines = _stream(spark, reshape.slice_fields(suppliers(spark, sf), ["s_nationkey", "s_name"]), ["k", "nation", "names"])
    path = store.work_path(spark, "collapsed")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    out = streams.collapse_stream(lines, "nation", ["names"])
    out.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{path}.state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(path)
