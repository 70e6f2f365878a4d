"""Queries over tables on disk: indexes, stores that are written in place, kept filters and edges; each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from ..functions.cells import says_true, truthy
from ..model import keyed
from ..operators import aggregate, filters, graph, joins, reshape
from ..operators.entity import entity_of
from ..operators.knowledge import KnowledgeBase, open_knowledge
from ..sources import blocks, store, text
from ..sources.clustered import IntervalIndex
from ..sources.keyed_store import Conflict, KeyedStore
from ..streaming import stateful
from ..streaming import tables as streams
from .oracles import SPANS
from .queries import customers, knowledge, nations, order_spans, parts, shown, suppliers, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


@query(f"with {SPANS} select key, start, \"end\", q_start, q_end from spans, (values (8100, 8102), (9500, 9500), (9900, 9990)) q(q_start, q_end) where start <= q_end and \"end\" >= q_start")
def interval_index(spark, sf):
    """Orders that were open in some times, from an index on disk that tells which files to read."""
    index = IntervalIndex.save(order_spans(spark, sf), store.work_path(spark, "intervals"), files=16)
    return index.query_all([(8100, 8102), (9500, 9500), (9900, 9990)])


@query("select c_custkey::varchar as c_custkey, case when c_nationkey = 3 then lower(c_name) else c_name end as c_name, case when c_nationkey in (3, 4) then 'MOVED' else c_mktsegment end as c_mktsegment from customer where c_nationkey <> 5 union all select 'new', 'nobody', 'NONE'")
def store_in_place(spark, sf):
    """A store that is written in batches, of which one fails halfway and leaves no trace."""
    t = reshape.slice_fields(customers(spark, sf), ["c_name", "c_mktsegment"])
    kept = KeyedStore.create(t, store.work_path(spark, "store"), shards=16)
    of = lambda n: table(spark, sf, "customer").filter(F.col("c_nationkey").isin(n)).select(F.col("c_custkey").cast("string").alias("c_custkey"), (F.lower("c_name") if n == [3] else F.col("c_name")).alias("c_name"), F.lit("MOVED").alias("c_mktsegment"))
    kept.put(keyed(of([3, 4]), "c_custkey"))
    broken = KeyedStore(spark, kept.path)
    broken._commit = lambda manifest: (_ for _ in ()).throw(Conflict("lost"))
    try:
        broken.delete(of([1, 2]).select("c_custkey"))
    except Conflict:
        pass
    kept.put(keyed(of([3]), "c_custkey"))
    kept.delete(table(spark, sf, "customer").filter("c_nationkey = 5").select("c_custkey"))
    kept.put(keyed(spark.createDataFrame([("new", "nobody", "NONE")], "c_custkey string, c_name string, c_mktsegment string"), "c_custkey"))
    return shown(kept.read())


@query("select o_custkey::varchar as o_custkey, string_agg(o_orderkey::varchar, '|' order by place, o_orderkey) as o_orderkey from (select o_custkey, o_orderkey, 0 as place from orders where o_orderstatus <> 'P' union all select o_custkey, o_orderkey, 1 from orders where o_orderstatus = 'P') group by 1")
def store_merged(spark, sf):
    """Lists that are added to those of their keys; only the shards of these are written."""
    df = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("o_custkey"), F.array(F.col("o_orderkey").cast("string")).alias("o_orderkey"), F.col("o_orderkey").alias("at"), "o_orderstatus")
    part = lambda of: keyed(df.filter(of), "o_custkey", ["o_orderkey"], "double", "at")
    kept = KeyedStore.create(part("o_orderstatus <> 'P'"), store.work_path(spark, "store"), shards=16)
    kept.merge(part("o_orderstatus = 'P'"))
    return shown(kept.read())


@query("select c_custkey::varchar as c_custkey, c_name, c_nationkey::varchar as c_nationkey from customer")
def block_gzip(spark, sf):
    """A table written as block-gzip files and read by ranges of blocks."""
    t = reshape.slice_fields(customers(spark, sf), ["c_name", "c_nationkey"])
    files = blocks.write_lines(text.dump_lines(t.with_df(t.df.repartition(3))), store.work_path(spark, "blocks"), in_block=1000)
    header = text.parse_header(["#c_custkey\tc_name\tc_nationkey"])
    return shown(text.parse_lines(text.read_lines(spark, files), header, shape="list"))


@query("with g as (select event_id, event_type, user_id, row_number() over (order by event_id) - row_number() over (partition by event_type order by event_id) as island from events) select event_type, string_agg(user_id::varchar, '|' order by event_id) as users, min(event_id) as first_event from g group by event_type, island")
def collapse_runs(spark, sf):
    """Events in a row that are of one type."""
    df = table(spark, sf, "events").select("event_type", F.col("user_id").cast("string").alias("users"), F.col("event_id").cast("string").alias("ids"), "event_id")
    t = aggregate.collapse_runs(keyed(df, "event_type", ["users", "ids"], "list", "event_id"))
    return t.df.select("event_type", "users", F.split("ids", "\\|")[0].cast("bigint").alias("first_event"))


@query("with a as (select c_custkey::varchar as k, c_name as name from customer where c_nationkey < 9), b as (select o_custkey::varchar as k, count(*)::varchar as n_orders from orders where o_orderstatus = 'F' group by 1), c as (select c_custkey::varchar as k, c_mktsegment as name2 from customer where c_acctbal < 2000) select coalesce(a.k, b.k, c.k) as custkey, name, n_orders, name2 as \"name (2)\" from a full join b on a.k = b.k full join c on coalesce(a.k, b.k) = c.k")
def paste_stored(spark, sf):
    """Three stored tables side by side, bucket by bucket."""
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    key = F.col("c_custkey").cast("string").alias("custkey")
    rows = [c.filter("c_nationkey < 9").select(key, F.col("c_name").alias("name")), o.filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").cast("string").alias("custkey")).agg(F.count("*").cast("string").alias("n_orders")), c.filter("c_acctbal < 2000").select(key, F.col("c_mktsegment").alias("name"))]
    names = [f"pasted_{n}_{store.work_path(spark, 'x')[-32:]}" for n in range(3)]
    for df, name in zip(rows, names, strict=True):
        store.save_bucketed(keyed(df, "custkey"), name, 8, store.work_path(spark, "bucketed"))
    return joins.paste_stored(spark, names, "custkey")


@query("select c_custkey::varchar as c_custkey, c_name from customer where c_mktsegment = 'BUILDING' and c_nationkey = 7")
def filter_stack_kept(spark, sf):
    """Saved filters that take the rows of a stream as they come, one batch of them twice."""
    t = reshape.slice_fields(customers(spark, sf), ["c_name", "c_nationkey", "c_mktsegment"])
    rows, saved = store.work_path(spark, "rows"), store.work_path(spark, "filters")
    source, number = store.work_path(spark, "source"), F.pmod(F.xxhash64("c_custkey"), F.lit(3))
    t.df.withColumn("batch", number).write.partitionBy("batch").parquet(source)
    part = lambda n: spark.read.schema(t.df.schema).parquet(f"{source}/batch={n}")
    part(0).write.parquet(f"{rows}/batch=-1")
    stack = filters.FilterStack(t.with_df(part(0)), saved).add("c_mktsegment", "BUILDING").add("c_nationkey", "7")
    stream = spark.readStream.schema(t.df.schema).option("maxFilesPerTrigger", 1).parquet(f"{source}/batch=[12]")
    streams.maintain(stream, rows, [stack], store.work_path(spark, "state")).awaitTermination()
    stack.append(part(1), 1)  # again
    now = t.with_df(spark.read.schema(t.df.schema).parquet(rows).drop("batch"))
    return shown(reshape.slice_fields(stack.result(now), ["c_name"]))


@query("select s_suppkey::varchar as source, s_nationkey::varchar as target, s_name, 'child' as direction from supplier where s_suppkey in (3, 40, 77) union all select s_suppkey::varchar, s_nationkey::varchar, s_name, 'parent' from supplier where s_nationkey::varchar in ('3', '40', '77')")
def kb_kept_edges(spark, sf):
    """Edges kept by both ends; each look-up reads the files of its end."""
    kb = knowledge(spark, sf)
    kb.keep_edges("ships_from", store.work_path(spark, "edges"), files=8)
    return kb.neighbours("ships_from", ["3", "40", "77"])


@query("""with m as (select c_nationkey::varchar as target, count(*)::double as n, count(*) filter (c_mktsegment = 'BUILDING' and c_acctbal > 0)::double as hits from customer group by 1),
t as (select *, sum(n) over () as total, sum(hits) over () as drawn from m),
p as (select *, case when hits = 0 then 1 else least(1, list_sum(list_transform(range(hits::bigint, least(n, drawn)::bigint + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + lgamma(total - n + 1) - lgamma(drawn - i + 1) - lgamma(total - n - drawn + i + 1) - lgamma(total + 1) + lgamma(drawn + 1) + lgamma(total - drawn + 1))))) end as p from t),
r as (select *, p * count(*) over () / row_number() over (order by p, target) as v, row_number() over (order by p, target) as rank from p)
select target, n::bigint as n, hits::bigint as hits, round(p, 9) as p, round(least(1, min(v) over (order by rank desc)), 9) as adjusted from r""")
def kb_enrichment(spark, sf):
    """Nations in which customers of a segment with money are more than chance would have it."""
    some = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING' and c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("entity"))
    found = knowledge(spark, sf).enrichment("lives_in", some)
    return found.select("target", "n", "hits", F.round("p", 9).alias("p"), F.round("adjusted", 9).alias("adjusted"))


# Several knowledge bases, kept filters together, and other ways to look at a table


@query("with e as (select 'north' as base, c_custkey::varchar as source, c_nationkey::varchar as target from customer where c_nationkey < 12 union all select 'south', c_custkey::varchar, c_nationkey::varchar from customer where c_nationkey >= 9) select base, source as customer, target as nation, s_suppkey::varchar as supplier from e join supplier on target = s_nationkey::varchar where s_acctbal > 6000")
def kb_registries(spark, sf):
    """A rule over two saved knowledge bases, and a relation of the one that includes them."""
    kb = knowledge(spark, sf)
    for base, part in (("north", "c_nationkey < 12"), ("south", "c_nationkey >= 9")):
        t, folder = customers(spark, sf), store.work_path(spark, base)
        saved = KnowledgeBase(spark, base, entity_options={"c_nationkey": {"format": "number"}})
        saved.register("lives_in", t.with_df(t.df.filter(part)), source="c_custkey", target="c_nationkey", info=["c_mktsegment"])
        saved.save(folder)
        kb.include(base, open_knowledge(spark, folder))
        assert kb.others[base].entity_options == {"c_nationkey": {"format": "number"}}
    kb.save_list("rich", table(spark, sf, "supplier").filter("s_acctbal > 6000").select(F.col("s_suppkey").cast("string")))
    found = kb.traverse("?supplier = :rich\n?supplier ships_from ?nation\n?customer lives_in@?base ?nation").paths
    return found.select(F.col("?base").alias("base"), F.col("?customer").alias("customer"), F.col("?nation").alias("nation"), F.col("?supplier").alias("supplier"))


@query("select c_custkey::varchar as source, c_nationkey::varchar as target, 'c_custkey' as source_entity, 'c_nationkey in trade' as target_entity from customer")
def kb_typed_edges(spark, sf):
    """Edges whose ends know what entities they are, with options that saving keeps."""
    folder, kb = store.work_path(spark, "knowledge"), knowledge(spark, sf)
    kb.entity_options["c_nationkey"] = {"format": "number"}
    kb.save(folder)
    e = open_knowledge(spark, folder).typed_edges("lives_in")
    assert e.schema["target"].metadata["format"] == "number"
    return e.select("source", "target", F.lit(entity_of(e, "source")).alias("source_entity"), F.lit(f"{entity_of(e, 'target')} in {e.schema['target'].metadata['namespace']}").alias("target_entity"))


@query("select c_custkey::varchar as key from customer where c_mktsegment = 'BUILDING' or (c_nationkey = 7 and c_mktsegment = 'MACHINERY')")
def keys_of_any(spark, sf):
    """The keys that either of two stacks of saved filters leaves."""
    folder, t = store.work_path(spark, "filters"), reshape.slice_fields(customers(spark, sf), ["c_nationkey", "c_mktsegment"])
    one = filters.FilterStack(t, folder).add("c_mktsegment", "BUILDING")
    two = filters.FilterStack(t, folder).add("c_nationkey", "7").add("c_mktsegment", "MACHINERY")
    return filters.keys_of_any([one, two])


@query("select concat_ws(chr(9), p_partkey::varchar, p_name, p_brand, p_type, p_size::varchar) as line, 5::bigint as cells, p_size::varchar as last_cell from part")
def lines_and_matrix(spark, sf):
    """A file as lines, and each line as its cells."""
    path = store.work_path(spark, "tsv")
    text.write_tsv(parts(spark, sf), path)
    cells = text.split_row(F.col("value"), "\t")
    return text.read_lines(spark, f"{path}/part-*").select(F.col("value").alias("line"), F.size(cells).cast("bigint").alias("cells"), F.element_at(cells, -1).alias("last_cell"))


@query("select n_regionkey::varchar as region, array_to_string(flatten(list([n_nationkey::varchar, n_name] order by n_nationkey)), '|') as cells from nation group by 1")
def reorder_flat(spark, sf):
    """All fields of the rows of a new key in one list."""
    t = reshape.reorder(reshape.to_shape(nations(spark, sf), "double"), "n_regionkey", ["n_nationkey", "n_name"], one2one=False, shape="flat", merge=True)
    return t.df.select(F.col("n_regionkey").alias("region"), F.array_join(t.fields[0], "|").alias("cells"))


@query("select c_custkey::varchar || '~' || c_nationkey::varchar as pair, c_nationkey::varchar || '~' || c_custkey::varchar as inverted, c_nationkey::varchar as other_end, 'c_mktsegment=' || c_mktsegment as info from customer")
def edge_properties(spark, sf):
    """An edge by its name, turned round, taken apart again, and with what is known of it."""
    e = graph.pair_names(knowledge(spark, sf).all("lives_in"))
    apart = graph.split_pairs(e.drop("source", "target"))
    return apart.select("pair", F.concat_ws("~", "target", "source").alias("inverted"), F.col("target").alias("other_end"), F.concat(F.lit("c_mktsegment="), "c_mktsegment").alias("info"))


@query("select c_custkey, said, said <> '' and lower(said) <> 'false' as holds, regexp_matches(said, '\\btrue\\b') as says_true from (select c_custkey, case c_custkey % 4 when 0 then '' when 1 then 'False' when 2 then 'is true' else c_mktsegment end as said from customer)")
def boolean_text(spark, sf):
    """Text as truth, in the two ways that filters and rules have."""
    said = F.when(F.col("c_custkey") % 4 == 0, "").when(F.col("c_custkey") % 4 == 1, "False").when(F.col("c_custkey") % 4 == 2, "is true").otherwise(F.col("c_mktsegment"))
    return table(spark, sf, "customer").select("c_custkey", said.alias("said")).select("c_custkey", "said", truthy(F.col("said")).alias("holds"), says_true(F.col("said")).alias("says_true"))


@query("select s_nationkey::varchar as nation, count(*) as n, round(sum(s_acctbal), 2) as total, round(avg(s_acctbal), 2) as mean, min(s_acctbal) as least, max(s_acctbal) as most from supplier group by 1")
def field_math(spark, sf):
    """Numbers in text cells added up by key."""
    t = reshape.column(reshape.change_key(reshape.to_shape(suppliers(spark, sf), "double"), "s_nationkey"), "s_acctbal", "to_f")
    values = t.df.select(F.col("s_nationkey").alias("nation"), F.explode("s_acctbal").alias("v"))
    return values.groupBy("nation").agg(F.count("*").alias("n"), F.round(F.sum("v"), 2).alias("total"), F.round(F.avg("v"), 2).alias("mean"), F.min("v").alias("least"), F.max("v").alias("most"))


# Streams with state


@query("with a as (select c_custkey::varchar as k, c_name from customer where c_nationkey < 9), b as (select c_custkey::varchar as k, c_mktsegment from customer where c_acctbal > 5000), c as (select c_custkey::varchar as k, c_nationkey::varchar as c_nationkey, c_acctbal > 0 as rich from customer where c_acctbal < 6000) select coalesce(a.k, b.k, c.k) as custkey, c_name, c_mktsegment, c_nationkey, rich::varchar as rich from a full join b on a.k = b.k full join c on coalesce(a.k, b.k) = c.k")
def stream_paste(spark, sf):
    """Three streams side by side by key; the last row of all only moves the watermark."""
    at = lambda c: F.timestamp_seconds(86_400 + (F.col(c) if isinstance(c, str) else c)).alias("at")
    t, key = table(spark, sf, "customer"), F.col("c_custkey").cast("string").alias("custkey")
    parts = [t.filter("c_nationkey < 9").select(key, at("c_custkey"), "c_name"), t.filter("c_acctbal > 5000").select(key, at("c_custkey"), "c_mktsegment"), t.filter("c_acctbal < 6000").select(key, at("c_custkey"), "c_nationkey", (F.col("c_acctbal") > 0).alias("rich"))]
    end = spark.range(1).select(F.lit("end").alias("custkey"), at(F.lit(10**10)), F.lit("").alias("c_name"))
    parts[0] = parts[0].unionByName(end)
    out = stateful.paste_all([_as_stream(spark, p) for p in parts], "custkey", "at", "0 seconds")
    return _ran(out, "pasted")


@query("select s_nationkey::varchar as nation, string_agg(s_name, '|' order by s_suppkey) as names from supplier group by 1")
def stream_running(spark, sf):
    """Lists by key that grow batch by batch; each batch puts only the keys that changed in a store."""
    t = table(spark, sf, "supplier").select("s_nationkey", F.timestamp_seconds(86_400 + F.col("s_suppkey")).alias("at"), F.col("s_name").alias("names"), F.col("s_suppkey").alias("n"))
    third = t.agg((F.floor(F.max("n") / 3) + 1).cast("long")).first()[0] or 1
    lines = _as_stream(spark, t.withColumnRenamed("s_nationkey", "nation"), F.floor(F.col("n") / third))
    out = stateful.collapse_running(lines, "nation", "at", ["names"], "1 day", 10**9)
    kept = KeyedStore.create(keyed(spark.createDataFrame([], "nation string, names string"), "nation"), store.work_path(spark, "running"), shards=4)
    write = lambda batch, number: kept.put(keyed(batch, "nation", ["names"]))
    out.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", store.work_path(spark, "state")).trigger(availableNow=True).start().awaitTermination()
    return shown(kept.read())


def _as_stream(spark, df, batch=None):
    """df as a stream; batch: a column that tells its batches apart."""
    path = store.work_path(spark, "stream")
    for n in sorted(r[0] for r in df.select(batch).distinct().collect()) if batch is not None else [0]:
        (df.filter(batch == n) if batch is not None else df).coalesce(1).write.parquet(f"{path}/b={n}")
    stream = spark.readStream.schema(df.schema)
    return (stream.option("maxFilesPerTrigger", 1) if batch is not None else stream).parquet(f"{path}/b=*")


def _ran(stream, label):
    """All that a stream has, written by it and read back."""
    path = store.work_path(stream.sparkSession, label)
    stream.writeStream.format("parquet").option("checkpointLocation", f"{path}.state").trigger(availableNow=True).start(path).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
