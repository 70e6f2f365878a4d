"""Queries over the given tables, one or more for each operator family.

Every query takes (spark, sf_dir) and works on whole tables. Lists are shown as text, joined by '|', so
that results compare by value."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cells import join_cell, to_float, to_int
from ..model import ORD, KeyedTable, keyed, quoted
from ..operators import aggregate, filters, graph, joins, ranges, reshape, sets, sorting, translate
from ..operators.entity import Entity, annotation_table, from_annotation_table, typed
from ..operators.knowledge import KnowledgeBase
from ..operators.workflow import Input, Workflow
from ..sources import store, text
from ..streaming import tables as streams

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


def shown(t: KeyedTable) -> DataFrame:
    """Key and fields, lists as text."""
    return t.df.select(quoted(t.key), *[(join_cell(quoted(f)) if t.listed else quoted(f)).alias(f) for f in t.fields])


def orders(spark: SparkSession, sf: str) -> KeyedTable:
    df = texts(table(spark, sf, "orders"), "o_orderkey", "o_custkey")
    return keyed(df, "o_custkey", ["o_orderkey", "o_orderstatus", "o_orderpriority"], "list", F.col("o_orderkey").cast("bigint"))


def orders_by_customer(spark: SparkSession, sf: str) -> KeyedTable:
    return aggregate.merge_by_key(reshape.to_shape(orders(spark, sf), "double"))


def customers(spark: SparkSession, sf: str) -> KeyedTable:
    df = texts(table(spark, sf, "customer"), "c_custkey", "c_nationkey", "c_acctbal")
    return keyed(df, "c_custkey", ["c_name", "c_nationkey", "c_mktsegment", "c_acctbal"], "list", F.col("c_custkey").cast("bigint"))


def nations(spark: SparkSession, sf: str) -> KeyedTable:
    df = texts(table(spark, sf, "nation"), "n_nationkey", "n_regionkey")
    return keyed(df, "n_nationkey", ["n_name", "n_regionkey"], "list", F.col("n_nationkey").cast("bigint"))


def regions(spark: SparkSession, sf: str) -> KeyedTable:
    return keyed(texts(table(spark, sf, "region"), "r_regionkey"), "r_regionkey", ["r_name"], "list", F.col("r_regionkey").cast("bigint"))


def suppliers(spark: SparkSession, sf: str) -> KeyedTable:
    df = texts(table(spark, sf, "supplier"), "s_suppkey", "s_nationkey", "s_acctbal")
    return keyed(df, "s_suppkey", ["s_name", "s_nationkey", "s_acctbal"], "list", F.col("s_suppkey").cast("bigint"))


def parts(spark: SparkSession, sf: str) -> KeyedTable:
    df = texts(table(spark, sf, "part"), "p_partkey", "p_size")
    return keyed(df, "p_partkey", ["p_name", "p_brand", "p_type", "p_size"], "list", F.col("p_partkey").cast("bigint"))


def lines(spark: SparkSession, sf: str) -> KeyedTable:
    """Lineitem by order, in an order that is total but for equal rows."""
    df = table(spark, sf, "lineitem")
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_linestatus")
    df = df.select(F.col("l_orderkey").cast("string").alias("l_orderkey"), F.col("l_partkey").cast("string").alias("l_partkey"), "l_returnflag", "l_linestatus", order.alias(ORD))
    return keyed(df, "l_orderkey", ["l_partkey", "l_returnflag", "l_linestatus"], "list")


def lines_by_order(spark: SparkSession, sf: str) -> KeyedTable:
    return aggregate.merge_by_key(reshape.to_shape(lines(spark, sf), "double"))


# Merging and shapes


@query
def merged_orders_of_segment(spark, sf):
    t = joins.attach(orders_by_customer(spark, sf), customers(spark, sf), ["c_name", "c_mktsegment"], match_key="o_custkey", other_key="c_custkey")
    t = filters.select(t, {"c_mktsegment": "BUILDING"})
    return t.df.select(F.col("o_custkey").alias("cust"), F.col("c_name")[0].alias("name"), F.size("o_orderkey").cast("bigint").alias("n_orders"), join_cell(F.col("o_orderstatus")).alias("statuses"))


@query
def merge_by_key(spark, sf):
    return shown(lines_by_order(spark, sf))


@query
def merge_last_wins(spark, sf):
    return shown(aggregate.merge_by_key(orders(spark, sf)))


@query
def merge_flat(spark, sf):
    t = reshape.to_shape(reshape.slice_fields(orders(spark, sf), ["o_orderstatus", "o_orderpriority"]), "flat")
    return shown(aggregate.merge_by_key(t))


@query
def merge_one2one_padding(spark, sf):
    t = reshape.to_shape(orders(spark, sf), "double")
    t = t.with_df(t.df.withColumn("o_orderpriority", F.when(F.col("o_orderstatus")[0] == "P", F.array().cast("array<string>")).otherwise(F.col("o_orderpriority"))))
    return shown(aggregate.merge_by_key(t, one2one=True))


@query
def collapse(spark, sf):
    return shown(aggregate.collapse(reshape.slice_fields(orders(spark, sf), ["o_orderkey", "o_orderpriority"])))


@query
def shape_single(spark, sf):
    return shown(reshape.to_shape(lines_by_order(spark, sf), "single"))


@query
def shape_list(spark, sf):
    return shown(reshape.to_shape(lines_by_order(spark, sf), "list"))


@query
def shape_flat(spark, sf):
    return shown(reshape.to_shape(lines_by_order(spark, sf), "flat"))


@query
def table_summary(spark, sf):
    return aggregate.summary(orders_by_customer(spark, sf))


# Projections and re-keying


@query
def slice_fields(spark, sf):
    return shown(reshape.slice_fields(parts(spark, sf), ["p_brand", "p_name"]))


@query
def column_cast(spark, sf):
    return shown(reshape.column(customers(spark, sf), "c_acctbal", "to_f"))


@query
def cast_by_name(spark, sf):
    t = reshape.cast_fields(reshape.slice_fields(parts(spark, sf), ["p_name", "p_brand"]), "upcase", ["p_name"])
    return shown(reshape.cast_fields(t, "to_i", ["p_brand"]))


@query
def process_field(spark, sf):
    return shown(reshape.process(reshape.slice_fields(parts(spark, sf), ["p_type", "p_brand"]), "p_type", lambda c: F.concat(F.lower(c), F.lit("!"))))


@query
def add_field(spark, sf):
    t = reshape.add_field(orders_by_customer(spark, sf), "n", F.size("o_orderkey").cast("string"))
    return shown(reshape.slice_fields(t, ["n", "o_orderstatus"]))


@query
def rename_fields(spark, sf):
    return shown(reshape.rename(nations(spark, sf), {"n_nationkey": "id", "n_name": "name"}))


@query
def reorder_merge(spark, sf):
    t = reshape.to_shape(suppliers(spark, sf), "double")
    return shown(reshape.reorder(t, "s_nationkey", ["s_suppkey", "s_name"]))


@query
def change_key_one2one(spark, sf):
    return shown(reshape.change_key(reshape.slice_fields(orders_by_customer(spark, sf), ["o_orderkey", "o_orderpriority"]), "o_orderkey", keep=True, one2one=True))


@query
def change_key_strict(spark, sf):
    t = reshape.slice_fields(orders_by_customer(spark, sf), ["o_orderkey", "o_orderstatus"])
    t = t.with_df(t.df.withColumn("o_orderstatus", F.slice("o_orderstatus", 1, 2)))
    return shown(reshape.change_key(t, "o_orderkey", one2one="strict"))


@query
def change_key_whole(spark, sf):
    t = reshape.slice_fields(orders_by_customer(spark, sf), ["o_orderkey", "o_orderstatus"])
    return shown(reshape.change_key(t, "o_orderkey", keep=True))


@query
def change_key_flat(spark, sf):
    t = reshape.to_shape(reshape.slice_fields(suppliers(spark, sf), ["s_nationkey"]), "flat")
    return shown(reshape.reorder(t, "s_nationkey"))


@query
def unzip(spark, sf):
    return shown(reshape.unzip(lines_by_order(spark, sf), "l_partkey"))


@query
def unzip_merge(spark, sf):
    return shown(reshape.unzip(lines_by_order(spark, sf), "l_returnflag", merge=True))


@query
def unzip_replicates(spark, sf):
    return shown(reshape.unzip_replicates(lines_by_order(spark, sf)))


@query
def zip_key(spark, sf):
    t = reshape.unzip(lines_by_order(spark, sf), "l_returnflag", merge=True)
    return shown(reshape.zip_key(t, "l_returnflag"))


@query
def melt(spark, sf):
    return shown(reshape.melt(reshape.slice_fields(parts(spark, sf), ["p_name", "p_brand", "p_size"]), "value", "field"))


@query
def transpose(spark, sf):
    t = reshape.transpose(nations(spark, sf), "field", [str(i) for i in range(25)])
    return shown(t).select("field", F.concat_ws("|", *[quoted(str(i)) for i in range(25)]).alias("cells"))


@query
def remove_duplicates(spark, sf):
    return shown(reshape.remove_duplicates(reshape.slice_fields(lines_by_order(spark, sf), ["l_returnflag", "l_linestatus"])))


# Filters


@query
def select_set(spark, sf):
    return shown(filters.select(parts(spark, sf), ["Brand#12", "Brand#34", "7", "STEEL"]))


@query
def select_pattern(spark, sf):
    return shown(filters.select(parts(spark, sf), re.compile("^Brand#1|EN$")))


@query
def select_text(spark, sf):
    return shown(filters.select(orders_by_customer(spark, sf), {"o_orderstatus": "P"}))


@query
def select_text_inverted(spark, sf):
    return shown(filters.select(orders_by_customer(spark, sf), {"o_orderstatus": "P"}, invert=True))


@query
def select_comparison(spark, sf):
    return shown(filters.select(customers(spark, sf), {"c_acctbal": ">=5000"}))


@query
def select_comparison_inverted(spark, sf):
    return shown(filters.select(customers(spark, sf), {"c_acctbal": "<5000"}, invert=True))


@query
def select_count(spark, sf):
    return shown(filters.select(orders_by_customer(spark, sf), {"o_orderkey": 12}))


@query
def select_keys(spark, sf):
    return shown(filters.select(customers(spark, sf), {":key": [str(i) for i in range(0, 3000, 2)]}))


@query
def select_several(spark, sf):
    return shown(filters.select(customers(spark, sf), {"c_mktsegment": ["BUILDING", "MACHINERY"], "c_acctbal": "<0"}))


@query
def select_function(spark, sf):
    return shown(filters.select(orders_by_customer(spark, sf), {"o_orderpriority": lambda v: F.startswith(v, F.lit("1"))}))


@query
def select_row_predicate(spark, sf):
    t = reshape.slice_fields(customers(spark, sf), ["c_name", "c_acctbal"])
    return shown(t.with_df(t.df.filter(filters.row_matches(t, ">9900", ["c_acctbal"]))))


@query
def prefix_keys(spark, sf):
    return shown(filters.prefix(customers(spark, sf), "11"))


@query
def subset_keys(spark, sf):
    wanted = table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").cast("string"))
    return shown(filters.subset(customers(spark, sf), wanted))


@query
def subset_anti(spark, sf):
    wanted = table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").cast("string"))
    return shown(filters.subset(customers(spark, sf), wanted, invert=True))


@query
def values_at(spark, sf):
    return filters.values_at(nations(spark, sf), ["7", "99", "3", "7"])


@query
def filter_stack(spark, sf):
    return shown(filters.FilterStack(lines_by_order(spark, sf)).add("field:l_returnflag", "R").add("field:l_linestatus", "O").result())


# Joins


@query
def attach_key(spark, sf):
    t = filters.select(customers(spark, sf), {"c_mktsegment": "BUILDING"})
    some = filters.select(orders_by_customer(spark, sf), {"o_orderstatus": "P"})
    return shown(joins.attach(reshape.slice_fields(t, ["c_name"]), some, ["o_orderkey", "o_orderpriority"], match_key="c_custkey", other_key="o_custkey"))


@query
def attach_complete(spark, sf):
    left = reshape.to_shape(reshape.slice_fields(filters.select(customers(spark, sf), {"c_mktsegment": "BUILDING"}), ["c_name"]), "double")
    right = filters.select(reshape.slice_fields(orders_by_customer(spark, sf), ["o_orderstatus"]), {"o_orderstatus": "P"})
    return shown(joins.attach(left, right, match_key="c_custkey", other_key="o_custkey", complete=True))


@query
def attach_column(spark, sf):
    some = filters.select(nations(spark, sf), {"n_regionkey": ["1", "2"]})
    t = reshape.slice_fields(suppliers(spark, sf), ["s_name", "s_nationkey"])
    return shown(joins.attach(t, some, ["n_name", "n_regionkey"], match_key="s_nationkey", other_key="n_nationkey"))


@query
def attach_list_column(spark, sf):
    """Each order's parts, matched through a list-valued column."""
    t = reshape.slice_fields(lines_by_order(spark, sf), ["l_partkey"])
    return shown(joins.attach(t, reshape.slice_fields(parts(spark, sf), ["p_brand"]), match_key="l_partkey", other_key="p_partkey"))


@query
def attach_other_key(spark, sf):
    """Nations with the suppliers that name them: the other table is re-keyed first."""
    t = reshape.to_shape(reshape.slice_fields(nations(spark, sf), ["n_name"]), "double")
    return shown(joins.attach(t, reshape.to_shape(suppliers(spark, sf), "double"), ["s_name"], match_key="n_nationkey", other_key="s_nationkey"))


@query
def attach_fill(spark, sf):
    """Empty cells are filled from another table with the same field."""
    t = reshape.slice_fields(customers(spark, sf), ["c_mktsegment"])
    holes = t.with_df(t.df.withColumn("c_mktsegment", F.when(F.col("c_custkey").cast("bigint") % 3 == 0, "").when(F.col("c_custkey").cast("bigint") % 3 == 1, None).otherwise(F.col("c_mktsegment"))))
    return shown(joins.attach(holes, t, ["c_mktsegment"]))


@query
def attach_union(spark, sf):
    """Lists gain what is new."""
    statuses = reshape.slice_fields(orders_by_customer(spark, sf), ["o_orderstatus"])
    head = statuses.with_df(statuses.df.withColumn("o_orderstatus", F.slice("o_orderstatus", 1, 1)))
    return shown(joins.attach(head, statuses, ["o_orderstatus"]))


@query
def attach_index(spark, sf):
    """Customers with their nation's fields, through an index from names to nation keys."""
    found = joins.index(customers(spark, sf), "c_nationkey", ["c_name"])
    t = keyed(table(spark, sf, "customer"), "c_name", ["c_mktsegment"], "list", "c_custkey")
    return shown(joins.attach(t, reshape.slice_fields(nations(spark, sf), ["n_name"]), ["n_name"], match_key="c_name", index=found))


@query
def key_lookup(spark, sf):
    probes = table(spark, sf, "nation").select(F.col("n_name"), F.col("n_regionkey").cast("string").alias("region"))
    return joins.lookup(filters.select(regions(spark, sf), {"r_name": ["ASIA", "EUROPE"]}), probes, "region")


@query
def index_first(spark, sf):
    return joins.index(parts(spark, sf), ":key", ["p_brand", "p_type", "p_name"])


@query
def index_all_fields(spark, sf):
    return joins.index(nations(spark, sf), "n_name")


@query
def index_by_order(spark, sf):
    return joins.index(parts(spark, sf), ":key", ["p_type", "p_brand"], by_field=False)


@query
def paste(spark, sf):
    a = reshape.slice_fields(nations(spark, sf), ["n_name"])
    b = aggregate.merge_by_key(reshape.reorder(filters.select(suppliers(spark, sf), {"s_acctbal": ">9000"}), "s_nationkey", ["s_name"]))
    c = reshape.reorder(filters.select(customers(spark, sf), {"c_acctbal": "<-950"}), "c_nationkey", ["c_name"])
    return shown(joins.paste([a, b, c]))


@query
def paste_all_match(spark, sf):
    a = reshape.to_shape(filters.select(suppliers(spark, sf), {"s_acctbal": ">5000"}), "double")
    b = reshape.to_shape(filters.select(customers(spark, sf), {"c_acctbal": ">9800"}), "double")
    return shown(joins.paste([reshape.reorder(a, "s_nationkey", ["s_name"]), reshape.reorder(b, "c_nationkey", ["c_name"])], all_match=True))


@query
def paste_same_fields(spark, sf):
    a = reshape.rename(reshape.slice_fields(filters.select(nations(spark, sf), {"n_regionkey": ["0", "1"]}), ["n_name"]), {"n_nationkey": "id", "n_name": "name"})
    b = reshape.rename(reshape.slice_fields(filters.select(suppliers(spark, sf), {"s_acctbal": ">0"}), ["s_name"]), {"s_suppkey": "id", "s_name": "name"})
    return shown(joins.paste([a, b], same_fields=True, one2one=False))


# Translation


def mapping_tables(spark: SparkSession, sf: str) -> list[KeyedTable]:
    c = reshape.rename(reshape.slice_fields(customers(spark, sf), ["c_name", "c_nationkey"]), {"c_custkey": "Customer", "c_name": "Customer (name)", "c_nationkey": "Nation"})
    n = reshape.rename(nations(spark, sf), {"n_nationkey": "Nation", "n_name": "Nation (name)", "n_regionkey": "Region"})
    r = reshape.rename(regions(spark, sf), {"r_regionkey": "Region", "r_name": "Region (name)"})
    return [c, n, r]


@query
def translate_key(spark, sf):
    some = [filters.select(mapping_tables(spark, sf)[0], {"Nation": [str(i) for i in range(12)]})]
    t = reshape.rename(reshape.slice_fields(orders_by_customer(spark, sf), ["o_orderkey"]), {"o_custkey": "Customer"})
    return translate.translate(t, "Customer", "Customer (name)", some).df.select(F.col("Customer (name)").alias("customer"), join_cell(F.col("o_orderkey")).alias("orders"))


@query
def translate_column(spark, sf):
    t = reshape.rename(reshape.slice_fields(suppliers(spark, sf), ["s_nationkey", "s_name"]), {"s_nationkey": "Nation"})
    some = filters.select(mapping_tables(spark, sf)[1], {"Region": ["0", "3"]})
    return translate.translate(t, "Nation", "Nation (name)", [some]).df.select("s_suppkey", F.col("Nation (name)").alias("nation"), "s_name")


@query
def translate_list(spark, sf):
    t = reshape.to_shape(reshape.rename(reshape.reorder(reshape.to_shape(suppliers(spark, sf), "double"), "s_name", ["s_nationkey"]), {"s_nationkey": "Nation"}), "double")
    some = filters.select(mapping_tables(spark, sf)[1], {"Region": ["0", "3"]})
    return translate.translate(t, "Nation", "Nation (name)", [some]).df.select("s_name", join_cell(F.col("Nation (name)")).alias("nations"))


@query
def translation_two_hops(spark, sf):
    return translate.translation_index(mapping_tables(spark, sf), "Customer (name)", "Region")


@query
def translation_three_hops(spark, sf):
    return translate.translation_index(mapping_tables(spark, sf), "Customer", "Region (name)")


@query
def translation_from_any(spark, sf):
    return translate.translation_index(mapping_tables(spark, sf)[1:2], None, "Nation (name)")


# Ranges


def order_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Each order from its date to its last shipment, in days."""
    day = lambda c: F.unix_date(F.to_date(c)).cast("bigint")
    ends = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max(day("l_shipdate")).alias("end"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), day("o_orderdate").alias("start"))
    return o.join(ends, F.col("key") == F.col("l_orderkey")).select("key", F.least("start", "end").alias("start"), F.greatest("start", "end").alias("end"))


@query
def range_overlap(spark, sf):
    """Orders that were open in each week of an order day, counted."""
    day = F.unix_date(F.to_date("o_orderdate")).cast("bigint")
    weeks = table(spark, sf, "orders").select((F.floor(day / 7) * 7).cast("bigint").alias("q_start")).distinct().withColumn("q_end", F.col("q_start") + 6)
    found = ranges.overlaps(order_spans(spark, sf), weeks, 32)
    return found.groupBy("q_start").agg(F.count("*").alias("n"), F.sum("key").alias("keys"))


@query
def point_in_range(spark, sf):
    """All order days against all spans, counted a day."""
    points = table(spark, sf, "orders").select(F.unix_date(F.to_date("o_orderdate")).cast("bigint").alias("point")).distinct()
    found = ranges.at_points(order_spans(spark, sf), points, 32)
    return found.groupBy("point").agg(F.count("*").alias("n"), F.sum("key").alias("keys"))


@query
def range_query(spark, sf):
    return ranges.query(order_spans(spark, sf), 9500, 9510).select("key", "start", "end")


# Aggregates


@query
def field_match_counts(spark, sf):
    return aggregate.field_match_counts(parts(spark, sf), ["Brand#11", "Brand#12", "12", "17", "STEEL", "nothing"])


@query
def incidence(spark, sf):
    pairs = table(spark, sf, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("source"), F.col("c_mktsegment").alias("target"))
    return aggregate.incidence(pairs, targets=["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"])


@query
def incidence_least(spark, sf):
    pairs = table(spark, sf, "customer").select(F.col("c_nationkey").alias("source"), F.col("c_mktsegment").alias("target"), "c_acctbal")
    return aggregate.incidence(pairs, F.col("c_acctbal"), ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"])


@query
def adjacency(spark, sf):
    pairs = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("source"), F.col("s_name").alias("target"), F.when(F.col("s_acctbal") > 0, F.col("s_suppkey")).alias("v"))
    found = aggregate.adjacency(pairs, F.col("v"))
    return found.select("source", F.array_join("targets", "|").alias("targets"), F.array_join(F.transform("values", lambda v: v.cast("string")), "|").alias("numbers"))


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Events as jobs: each lasts as many seconds as its value says."""
    end = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + (F.floor("value") * 1_000_000).cast("bigint"))
    return table(spark, sf, "events").select("event_id", F.col("event_type").alias("task"), "user_id", F.col("ts").alias("start"), end.alias("end"))


@query
def trace_summary(spark, sf):
    return aggregate.trace_summary(jobs(spark, sf))


@query
def trace_times(spark, sf):
    return aggregate.trace_times(jobs(spark, sf), by="user_id").select("event_id", "user_id", "start_s", "end_s")


@query
def trace_times_with_gaps(spark, sf):
    return aggregate.trace_times(jobs(spark, sf), by="user_id", drop_gaps=False).select("event_id", "user_id", "start_s", "end_s")


# Order and paging


@query
def sort_by_field(spark, sf):
    return sorting.numbered(sorting.sort_by(reshape.slice_fields(nations(spark, sf), ["n_name"]), "n_name"))


@query
def page_of_customers(spark, sf):
    t = keyed(table(spark, sf, "customer"), "c_custkey", ["c_name", "c_acctbal"], "list", "c_custkey")
    return sorting.page(t, 3, 25, "c_acctbal", reverse=True)


@query
def page_by_list(spark, sf):
    t = sorting.page(orders_by_customer(spark, sf), 2, 40, "o_orderkey", reverse=True)
    return t.select("o_custkey", F.size("o_orderkey").cast("bigint").alias("n"))


@query
def head_rows(spark, sf):
    return sorting.head(reshape.slice_fields(parts(spark, sf), ["p_name"]), 17)


# Sets


def named(spark: SparkSession, sf: str) -> tuple[KeyedTable, KeyedTable]:
    a = reshape.rename(reshape.slice_fields(filters.select(nations(spark, sf), {"n_regionkey": ["0", "1", "2"]}), ["n_name"]), {"n_nationkey": "id", "n_name": "name"})
    b = reshape.rename(reshape.slice_fields(suppliers(spark, sf), ["s_name"]), {"s_suppkey": "id", "s_name": "name"})
    return a, b


@query
def concat_rows(spark, sf):
    return shown(sets.concat(named(spark, sf)))


@query
def concat_merge(spark, sf):
    return shown(sets.merge_zip(*[reshape.to_shape(t, "double") for t in named(spark, sf)]))


@query
def overlay(spark, sf):
    return shown(sets.overlay(*reversed(named(spark, sf))))


@query
def without_keys(spark, sf):
    return shown(sets.without(*reversed(named(spark, sf))))


@query
def common_keys(spark, sf):
    return shown(sets.common_keys(named(spark, sf)))


# Graphs


def customer_nation(spark: SparkSession, sf: str) -> DataFrame:
    return graph.edges(customers(spark, sf), "c_custkey", "c_nationkey", ["c_mktsegment"])


@query
def edges(spark, sf):
    return graph.pair_names(customer_nation(spark, sf))


@query
def edges_of_lists(spark, sf):
    return graph.edges(lines_by_order(spark, sf), None, "l_partkey")


@query
def edges_translated(spark, sf):
    c, n, _ = mapping_tables(spark, sf)
    t = reshape.slice_fields(c, ["Nation"])
    return graph.edges(t, "Customer=>Customer (name)", "Nation=>Nation (name)", identifiers=[c, filters.select(n, {"Region": ["1", "4"]})])


@query
def edges_undirected(spark, sf):
    """Nations of one region, next to each other by name."""
    return graph.edges(nations(spark, sf), "n_nationkey", "n_regionkey", [], undirected=True)


@query
def edge_match(spark, sf):
    return graph.match(graph.reverse(customer_nation(spark, sf)), ["3", "11"])


@query
def edge_subset(spark, sf):
    rich = table(spark, sf, "customer").filter("c_acctbal > 9000").select(F.col("c_custkey").cast("string"))
    return graph.subset(customer_nation(spark, sf), rich, ["1", "2", "3"])


@query
def edge_subset_undirected(spark, sf):
    e = graph.edges(nations(spark, sf), "n_nationkey", "n_regionkey", [], undirected=True)
    return graph.subset(e, [str(i) for i in range(10)], None, undirected=True)


@query
def edge_children(spark, sf):
    return graph.children(customer_nation(spark, sf), ["1", "20", "300"])


@query
def edge_parents(spark, sf):
    return graph.parents(customer_nation(spark, sf), "7")


@query
def edge_neighbours(spark, sf):
    return graph.neighbours(graph.edges(nations(spark, sf), "n_nationkey", "n_regionkey", ["n_name"]), ["1", "2"])


@query
def edge_filter(spark, sf):
    return filters.edge_filter(customer_nation(spark, sf), "c_mktsegment", "MACHINERY")


def knowledge(spark: SparkSession, sf: str) -> KnowledgeBase:
    kb = KnowledgeBase(spark, "trade")
    kb.register("lives_in", lambda: customers(spark, sf), source="c_custkey", target="c_nationkey", info=["c_mktsegment"])
    kb.register("part_of", lambda: nations(spark, sf), source="n_nationkey", target="n_regionkey", info=["n_name"], identifiers=[nations(spark, sf)])
    kb.register("ships_from", lambda: suppliers(spark, sf), source="s_suppkey", target="s_nationkey", info=["s_name"])
    return kb


@query
def kb_traverse(spark, sf):
    found = knowledge(spark, sf).traverse(["?customer lives_in ?nation", "?nation part_of 2"])
    return found.paths.select(F.col("?customer").alias("customer"), F.col("?nation").alias("nation"))


@query
def kb_condition(spark, sf):
    found = knowledge(spark, sf).traverse(["?supplier ships_from ?nation", "?customer lives_in ?nation - c_mktsegment=BUILDING", "?nation part_of 1"])
    return found.paths.select(F.col("?supplier").alias("supplier"), F.col("?customer").alias("customer"), F.col("?nation").alias("nation"))


@query
def kb_assignments(spark, sf):
    """A later rule doesn't narrow an earlier one again: the assignment is wider than the paths."""
    found = knowledge(spark, sf).traverse(["?customer lives_in ?nation", "?supplier ships_from ?nation", "?nation part_of 3"])
    return found.assignments["?customer"].select(F.col("entity").alias("customer"))


@query
def kb_assign(spark, sf):
    kb = knowledge(spark, sf)
    kb.save_list("some", ["5", "6"])
    found = kb.traverse("?n = 3, :some\n?customer lives_in ?n - c_mktsegment=HOUSEHOLD")
    return found.paths.select(F.col("?customer").alias("customer"), F.col("?n").alias("nation"))


@query
def kb_identified(spark, sf):
    """A nation named by its name is found in the naming of the relation."""
    name = table(spark, sf, "nation").agg(F.min("n_name")).first()[0]
    found = knowledge(spark, sf).traverse([f"?n =part_of {name}", "?customer lives_in ?n"])
    return found.paths.select(F.col("?customer").alias("customer"), F.col("?n").alias("nation"))


@query
def kb_block(spark, sf):
    found = knowledge(spark, sf).traverse(["?nation{", "?nation part_of ?region", "?supplier ships_from ?nation - s_name=Supplier#000000001", "}", "?customer lives_in ?nation"])
    return found.assignments["?customer"].select(F.col("entity").alias("customer"))


# Sources


@query
def csv_scan(spark, sf):
    path = store.work_path(spark, "csv")
    table(spark, sf, "customer").write.csv(path, header=True)
    t = text.read_csv(spark, path, key_field="c_custkey", fields=["c_name", "c_acctbal"])
    return reshape.process(t, "c_acctbal", to_float).public()


@query
def tsv_round_trip(spark, sf):
    path = store.work_path(spark, "tsv")
    text.write_tsv(lines_by_order(spark, sf), path)
    return shown(text.read_dump(spark, path))


@query
def tsv_field(spark, sf):
    """One field of a file, and only of the lines that match."""
    path = store.work_path(spark, "tsv")
    text.write_tsv(parts(spark, sf), path)
    lines_ = text.read_lines(spark, f"{path}/part-*").filter(F.col("value").rlike("Brand#2"))
    header = text.parse_header(text.header_lines(parts(spark, sf)))
    return shown(text.parse_lines(lines_, header, shape="list", fields=["p_brand"]))


@query
def tsv_unmerge(spark, sf):
    t = lines_by_order(spark, sf)
    rows = text.dump_lines(t, sep="\t", unmerge=True)
    return rows.groupBy("value").agg(F.count("*").alias("n"))


@query
def store_round_trip(spark, sf):
    path = store.work_path(spark, "store")
    store.save(orders_by_customer(spark, sf), path, sorted_by_key=True)
    return shown(filters.prefix(store.load(spark, path), "13"))


@query
def sharded_lookup(spark, sf):
    shard = lambda key: F.right(key, F.lit(1))
    path = store.work_path(spark, "shards")
    store.save_sharded(customers(spark, sf), path, shard)
    return shown(store.get_sharded(spark, path, shard, ["7", "17", "107", "1000007"]))


@query
def packed_positions(spark, sf):
    return store.at_positions(store.packed(reshape.slice_fields(suppliers(spark, sf), ["s_name"])), [1, 5, 999_999])


@query
def cached_table(spark, sf):
    folder = store.work_path(spark, "cache")
    make = lambda: orders_by_customer(spark, sf)
    store.cached(spark, folder, "orders", {"sf": sf}, make)
    return shown(store.cached(spark, folder, "orders", {"sf": sf}, make))


# Entities, annotations, workflows


def customer_entity(spark: SparkSession, sf: str) -> Entity:
    e = Entity("Customer", ["Customer", "Customer (name)"], mapping_tables(spark, sf))

    @e.property("number")
    def number(c: Column) -> Column:
        return to_int(F.regexp_extract(c, r"(\d+)$", 1))

    @e.property("initials", "array")
    def initials(s: pd.Series) -> pd.Series:
        return s.str.slice(0, 2).str.lower()

    @e.property("digits", "multiple", "long")
    def digits(s: pd.Series) -> pd.Series:
        return s.map(lambda x: sum(map(int, re.findall(r"\d", x))))

    return e


@query
def entity_single_property(spark, sf):
    df = typed(table(spark, sf, "customer").select("c_name"), "c_name", "Customer")
    return customer_entity(spark, sf).with_property(df, "c_name", "number")


@query
def entity_array_property(spark, sf):
    return customer_entity(spark, sf).with_property(table(spark, sf, "customer").select("c_custkey", "c_name"), "c_name", "initials").drop("c_name")


@query
def entity_multiple_property(spark, sf):
    e, df = customer_entity(spark, sf), table(spark, sf, "customer").select("c_custkey", "c_name")
    e.with_property(df.filter("c_custkey % 2 = 0"), "c_name", "digits")  # these are kept, and not computed again
    return e.with_property(df, "c_name", "digits").select("c_custkey", "digits")


@query
def entity_to_format(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("Customer"))
    return customer_entity(spark, sf).to(df, "Customer", "Customer (name)", "Customer", "name").select("o_orderkey", "name")


@query
def annotations(spark, sf):
    t = orders_by_customer(spark, sf)
    df = joins.attach(customers(spark, sf), t, ["o_orderstatus"], match_key="c_custkey", other_key="o_custkey").df.select("c_custkey", "c_name", "c_mktsegment", F.array("c_name", "c_mktsegment").alias("tags"))
    back = from_annotation_table(annotation_table(df, "c_custkey", ["c_name", "c_mktsegment"], ["tags"]), "c_mktsegment string, c_name string", ["tags"])
    return back.select("id", "c_mktsegment", "c_name", join_cell(F.col("tags")).alias("tags"))


def totals_workflow(sf: str) -> Workflow:
    w = Workflow("totals")

    @w.task(inputs=[Input("status", str, "F")])
    def chosen(spark, inputs):
        return table(spark, sf, "orders").filter(F.col("o_orderstatus") == inputs["status"])

    @w.task(deps=["chosen"], lazy=True)
    def by_customer(spark, inputs, found):
        return found.groupBy("o_custkey").agg(F.count("*").alias("n"))

    @w.task(deps=["by_customer", ("chosen", {"status": "P"})])
    def compared(spark, inputs, counts, open_):
        other = open_.groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n_open"))
        return counts.join(other, F.col("o_custkey") == F.col("k"), "left").select("o_custkey", "n", F.coalesce("n_open", F.lit(0)).alias("n_open"))

    return w


@query
def workflow_graph(spark, sf):
    job = totals_workflow(sf).job(spark, store.work_path(spark, "jobs"), "compared", status="O")
    job.run(parallel=2)
    return job.run()


# Event time


@query
def windowed_events(spark, sf):
    return streams.windowed(table(spark, sf, "events"), "ts", "1 day", ["event_type"], F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).drop("end")


@query
def event_sessions(spark, sf):
    return streams.sessions(table(spark, sf, "events"), "ts", "6 hours", ["user_id"], F.count("*").alias("n")).drop("end")
