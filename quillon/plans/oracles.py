"""DuckDB SQL for the queries of queries.py, by the same names."""

from __future__ import annotations

# Customers' orders and orders' lines as lists, in the order that the queries use.
OBC = """obc as (select o_custkey::varchar as o_custkey, list(o_orderkey::varchar order by o_orderkey) as ks, list(o_orderstatus order by o_orderkey) as ss,
  list(o_orderpriority order by o_orderkey) as ps from orders group by o_custkey)"""
LINE_ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag, l_linestatus"
LINES = f"""ln as (select l_orderkey::varchar as k, l_partkey::varchar as p, l_returnflag as f, l_linestatus as s,
  row_number() over (partition by l_orderkey order by {LINE_ORDER}) as i from lineitem)"""
CUST = "select c_custkey::varchar as c_custkey, c_name, c_nationkey::varchar as c_nationkey, c_mktsegment, c_acctbal::varchar as c_acctbal from customer"
OBC_SHOWN = f"with {OBC} select o_custkey, array_to_string(ks, '|') as o_orderkey, array_to_string(ss, '|') as o_orderstatus, array_to_string(ps, '|') as o_orderpriority from obc"
PARTS = "select p_partkey::varchar as p_partkey, p_name, p_brand, p_type, p_size::varchar as p_size from part"
NATIONS = "select n_nationkey::varchar as n_nationkey, n_name, n_regionkey::varchar as n_regionkey from nation"
DAY = "date_diff('day', date '1970-01-01', {}::date)"
SPANS = f"""spans as (select o_orderkey as key, least(s, e) as start, greatest(s, e) as "end" from
  (select o_orderkey, {DAY.format('o_orderdate')} as s, (select max({DAY.format('l_shipdate')}) from lineitem where l_orderkey = o_orderkey) as e from orders) where e is not null)"""
CN = "cn as (select c_custkey::varchar as source, c_nationkey::varchar as target, c_mktsegment from customer)"
NR = "nr as (select n_nationkey::varchar as source, n_regionkey::varchar as target, n_name from nation)"
UN = f"{NR}, un as (select source, target from nr union select target, source from nr)"
NAMED = """a as (select n_nationkey::varchar as id, n_name as name, n_nationkey as o from nation where n_regionkey in (0, 1, 2)),
  b as (select s_suppkey::varchar as id, s_name as name, s_suppkey as o from supplier)"""
JOBS = "jobs as (select event_id, event_type as task, user_id, epoch_us(ts) as s, epoch_us(ts) + floor(value)::bigint * 1000000 as e from events)"


def parallel(columns: str, where: str = "") -> str:
    """One order's lines, joined in order."""
    return f"with {LINES} select k as l_orderkey, {columns} from ln {where} group by k"


ORACLES = {
    "merged_orders_of_segment": f"with {OBC} select o_custkey as cust, c_name as name, len(ks) as n_orders, array_to_string(ss, '|') as statuses from obc join customer on c_custkey::varchar = o_custkey where c_mktsegment = 'BUILDING'",
    "merge_by_key": parallel("string_agg(p, '|' order by i) as l_partkey, string_agg(f, '|' order by i) as l_returnflag, string_agg(s, '|' order by i) as l_linestatus"),
    "merge_last_wins": "select o_custkey::varchar as o_custkey, max(o_orderkey)::varchar as o_orderkey, arg_max(o_orderstatus, o_orderkey) as o_orderstatus, arg_max(o_orderpriority, o_orderkey) as o_orderpriority from orders group by o_custkey",
    "merge_flat": "select o_custkey::varchar as o_custkey, string_agg(o_orderstatus || '|' || o_orderpriority, '|' order by o_orderkey) as o_orderstatus from orders group by o_custkey",
    "merge_one2one_padding": "select o_custkey::varchar as o_custkey, string_agg(o_orderkey::varchar, '|' order by o_orderkey) as o_orderkey, string_agg(o_orderstatus, '|' order by o_orderkey) as o_orderstatus, string_agg(case when o_orderstatus = 'P' then '' else o_orderpriority end, '|' order by o_orderkey) as o_orderpriority from orders group by o_custkey",
    "collapse": "select o_custkey::varchar as o_custkey, string_agg(o_orderkey::varchar, '|' order by o_orderkey) as o_orderkey, string_agg(o_orderpriority, '|' order by o_orderkey) as o_orderpriority from orders group by o_custkey",
    "shape_single": parallel("arg_min(p, i) as l_partkey"),
    "shape_list": parallel("arg_min(p, i) as l_partkey, arg_min(f, i) as l_returnflag, arg_min(s, i) as l_linestatus"),
    "shape_flat": parallel("string_agg(p, '|' order by i) || '|' || string_agg(f, '|' order by i) || '|' || string_agg(s, '|' order by i) as l_partkey"),
    "table_summary": "select count(distinct o_custkey) as size, 'o_custkey' as key, 'o_orderkey|o_orderstatus|o_orderpriority' as fields, 'double' as shape from orders",
    "slice_fields": "select p_partkey::varchar as p_partkey, p_brand, p_name from part",
    "column_cast": "select c_custkey::varchar as c_custkey, c_acctbal from customer",
    "cast_by_name": "select p_partkey::varchar as p_partkey, upper(p_name) as p_name, 0::bigint as p_brand from part",
    "process_field": "select p_partkey::varchar as p_partkey, lower(p_type) || '!' as p_type, p_brand from part",
    "add_field": "select o_custkey::varchar as o_custkey, count(*)::varchar as n, string_agg(o_orderstatus, '|' order by o_orderkey) as o_orderstatus from orders group by o_custkey",
    "rename_fields": "select n_nationkey::varchar as id, n_name as name, n_regionkey::varchar as n_regionkey from nation",
    "reorder_merge": "select s_nationkey::varchar as s_nationkey, string_agg(s_suppkey::varchar, '|' order by s_suppkey) as s_suppkey, string_agg(s_name, '|' order by s_suppkey) as s_name from supplier group by s_nationkey",
    "change_key_one2one": "select o_orderkey::varchar as o_orderkey, o_custkey::varchar as o_custkey, o_orderpriority from orders",
    "change_key_strict": "select o_orderkey::varchar as o_orderkey, case when row_number() over (partition by o_custkey order by o_orderkey) <= 2 then o_orderstatus else '' end as o_orderstatus from orders",
    "change_key_whole": f"with {OBC} select unnest(ks) as o_orderkey, o_custkey, array_to_string(ss, '|') as o_orderstatus from obc",
    "change_key_flat": "select s_nationkey::varchar as s_nationkey, string_agg(s_suppkey::varchar, '|' order by s_suppkey) as s_suppkey from supplier group by s_nationkey",
    "unzip": f"with {LINES}, z as (select k || ':' || p as id, arg_max(f, i) as f, arg_max(s, i) as s from ln group by 1) select id as \"l_orderkey:l_partkey\", f as l_returnflag, s as l_linestatus from z",
    "unzip_merge": f"with {LINES} select k || ':' || f as \"l_orderkey:l_returnflag\", string_agg(p, '|' order by i) as l_partkey, string_agg(s, '|' order by i) as l_linestatus from ln group by 1",
    "unzip_replicates": f"with {LINES} select k || '(' || (i - 1) || ')' as l_orderkey, p as l_partkey, f as l_returnflag, s as l_linestatus from ln",
    "zip_key": f"""with {LINES}, m as (select k, f, min(i) as first, string_agg(p, '|' order by i) as p, string_agg(s, '|' order by i) as s, string_agg(f, '|') as fs from ln group by k, f)
select k as l_orderkey, string_agg(fs, '|' order by first) as l_returnflag, string_agg(p, '|' order by first) as l_partkey, string_agg(s, '|' order by first) as l_linestatus from m group by k""",
    "melt": "select p_partkey || ':' || i as ID, p_partkey::varchar as p_partkey, v as value, f as field from (select p_partkey, 0 as i, 'p_name' as f, p_name as v from part union all select p_partkey, 1, 'p_brand', p_brand from part union all select p_partkey, 2, 'p_size', p_size::varchar from part)",
    "transpose": "select 'n_name' as field, string_agg(n_name, '|' order by n_nationkey) as cells from nation union all select 'n_regionkey', string_agg(n_regionkey::varchar, '|' order by n_nationkey) from nation",
    "remove_duplicates": f"with {LINES}, d as (select k, f, s, min(i) as i from ln group by k, f, s) select k as l_orderkey, string_agg(f, '|' order by i) as l_returnflag, string_agg(s, '|' order by i) as l_linestatus from d group by k",
    "select_set": f"with t as ({PARTS}) select * from t where p_partkey = '7' or p_brand in ('Brand#12', 'Brand#34') or 'STEEL' in (p_name, p_type) or p_size = '7'",
    "select_pattern": f"with t as ({PARTS}) select * from t where regexp_matches(p_brand, '^Brand#1') or regexp_matches(p_name, 'EN$') or regexp_matches(p_type, 'EN$') or regexp_matches(p_name, '^Brand#1')",
    "select_text": OBC_SHOWN + " where list_contains(ss, 'P')",
    "select_text_inverted": OBC_SHOWN + " where not list_contains(ss, 'P')",
    "select_comparison": CUST + " where customer.c_acctbal >= 5000",
    "select_comparison_inverted": CUST + " where not customer.c_acctbal < 5000",
    "select_count": OBC_SHOWN + " where len(ks) >= 12",
    "select_keys": CUST + " where customer.c_custkey % 2 = 0 and customer.c_custkey < 3000",
    "select_several": CUST + " where c_mktsegment in ('BUILDING', 'MACHINERY') and customer.c_acctbal < 0",
    "select_function": OBC_SHOWN + " where len([p for p in ps if p like '1%']) > 0",
    "select_row_predicate": "select c_custkey::varchar as c_custkey, c_name, c_acctbal::varchar as c_acctbal from customer where customer.c_acctbal > 9900",
    "prefix_keys": CUST + " where customer.c_custkey::varchar like '11%'",
    "subset_keys": CUST + " where customer.c_custkey in (select o_custkey from orders where o_orderstatus = 'P')",
    "subset_anti": CUST + " where customer.c_custkey not in (select o_custkey from orders where o_orderstatus = 'P')",
    "values_at": "select p.position::bigint as position, p.requested, n_name, n_regionkey::varchar as n_regionkey from (values (0, '7'), (1, '99'), (2, '3'), (3, '7')) p(position, requested) left join nation on n_nationkey::varchar = p.requested",
    "filter_stack": f"with {LINES} select k as l_orderkey, string_agg(p, '|' order by i) as l_partkey, string_agg(f, '|' order by i) as l_returnflag, string_agg(s, '|' order by i) as l_linestatus from ln group by k having bool_or(f = 'R') and bool_or(s = 'O')",
    "attach_key": f"with {OBC} select c_custkey::varchar as c_custkey, c_name, ks[1] as o_orderkey, ps[1] as o_orderpriority from customer left join obc on o_custkey = c_custkey::varchar and list_contains(ss, 'P') where c_mktsegment = 'BUILDING'",
    "attach_complete": f"with {OBC}, c as (select c_custkey::varchar as k, c_name from customer where c_mktsegment = 'BUILDING'), o as (select * from obc where list_contains(ss, 'P')) select coalesce(k, o_custkey) as c_custkey, coalesce(c_name, '') as c_name, coalesce(array_to_string(ss, '|'), '') as o_orderstatus from c full join o on k = o_custkey",
    "attach_column": "select s_suppkey::varchar as s_suppkey, s_name, s_nationkey::varchar as s_nationkey, n_name, n_regionkey::varchar as n_regionkey from supplier left join nation on s_nationkey = n_nationkey and n_regionkey in (1, 2)",
    "attach_list_column": f"""with {LINES}, b as (select k, p_brand, min(i) as i from ln join part on p_partkey::varchar = p group by k, p_brand)
select k as l_orderkey, string_agg(p, '|' order by i) as l_partkey, (select coalesce(string_agg(p_brand, '|' order by b.i), '') from b where b.k = ln.k) as p_brand from ln group by k""",
    "attach_other_key": "select n_nationkey::varchar as n_nationkey, n_name, coalesce((select string_agg(s_name, '|' order by s_name) from (select s_nationkey, s_name from supplier) where s_nationkey = n_nationkey), '') as s_name from nation",
    "attach_fill": "select c_custkey::varchar as c_custkey, c_mktsegment from customer",
    "attach_union": f"""with {OBC}, x as (select o_custkey, ss[1] as head, [s for s in ss if s <> ss[1]] as rest from obc)
select o_custkey, array_to_string(list_concat([head], rest), '|') as o_orderstatus from x""",
    "attach_index": "select c_name, c_mktsegment, n_name from customer left join nation on c_nationkey = n_nationkey",
    "key_lookup": "select n_name, n_regionkey::varchar as region, r_name from nation left join region on r_regionkey = n_regionkey and r_name in ('ASIA', 'EUROPE')",
    "index_first": "with v as (select p_brand as value, p_partkey, 0 as pos from part union all select p_type, p_partkey, 1 from part union all select p_name, p_partkey, 2 from part) select value, arg_min(p_partkey, pos * 1000000000 + p_partkey)::varchar as target from v group by value",
    "index_all_fields": "with v as (select n_name as value, n_name, 0 as pos, n_nationkey from nation union all select n_nationkey::varchar, n_name, 1, n_nationkey from nation union all select n_regionkey::varchar, n_name, 2, n_nationkey from nation) select value, arg_min(n_name, pos * 1000 + n_nationkey) as target from v group by value",
    "index_by_order": "with v as (select p_type as value, p_partkey, 0 as pos from part union all select p_brand, p_partkey, 1 from part) select value, arg_min(p_partkey, p_partkey * 10 + pos)::varchar as target from v group by value",
    "paste": """with a as (select n_nationkey::varchar as k, n_name from nation), b as (select s_nationkey::varchar as k, max_by(s_name, s_suppkey) as s_name from supplier where s_acctbal > 9000 group by 1),
c as (select c_nationkey::varchar as k, max_by(c_name, c_custkey) as c_name from customer where c_acctbal < -950 group by 1)
select coalesce(a.k, b.k, c.k) as n_nationkey, coalesce(n_name, '') as n_name, coalesce(s_name, '') as s_name, coalesce(c_name, '') as c_name from a full join b on a.k = b.k full join c on coalesce(a.k, b.k) = c.k""",
    "paste_all_match": """select s.k as s_nationkey, s_name, c_name from (select s_nationkey::varchar as k, string_agg(s_name, '|' order by s_suppkey) as s_name from supplier where s_acctbal > 5000 group by 1) s
join (select c_nationkey::varchar as k, string_agg(c_name, '|' order by c_custkey) as c_name from customer where c_acctbal > 9800 group by 1) c on s.k = c.k""",
    "paste_same_fields": "select coalesce(n.k, s.k) as id, concat_ws('|', n_name, s_name) as name from (select n_nationkey::varchar as k, n_name from nation where n_regionkey in (0, 1)) n full join (select s_suppkey::varchar as k, s_name from supplier where s_acctbal > 0) s on n.k = s.k",
    "translate_key": f"with {OBC} select c_name as customer, array_to_string(ks, '|') as orders from obc join customer on c_custkey::varchar = o_custkey where c_nationkey < 12",
    "translate_column": "select s_suppkey::varchar as s_suppkey, n_name as nation, s_name from supplier left join nation on s_nationkey = n_nationkey and n_regionkey in (0, 3)",
    "translate_list": "select s_name, coalesce(string_agg(n_name, '|' order by s_suppkey), '') as nations from supplier left join nation on s_nationkey = n_nationkey and n_regionkey in (0, 3) group by s_name",
    "translation_two_hops": "select c_name as value, n_regionkey::varchar as target from customer join nation on c_nationkey = n_nationkey",
    "translation_three_hops": "select c_custkey::varchar as value, r_name as target from customer join nation on c_nationkey = n_nationkey join region on r_regionkey = n_regionkey",
    "translation_from_any": "with v as (select n_name as value, n_name, 0 as pos, n_nationkey from nation union all select n_nationkey::varchar, n_name, 1, n_nationkey from nation union all select n_regionkey::varchar, n_name, 2, n_nationkey from nation) select value, arg_min(n_name, pos * 1000 + n_nationkey) as target from v group by value",
    "range_overlap": f"with {SPANS}, w as (select distinct {DAY.format('o_orderdate')} // 7 * 7 as q from orders) select q as q_start, count(*) as n, sum(key)::bigint as keys from w join spans on start <= q + 6 and \"end\" >= q group by q",
    "point_in_range": f"with {SPANS}, p as (select distinct {DAY.format('o_orderdate')} as point from orders) select point, count(*) as n, sum(key)::bigint as keys from p join spans on point between start and \"end\" group by point",
    "range_query": f"with {SPANS} select key, start, \"end\" from spans where start <= 9510 and \"end\" >= 9500",
    "field_match_counts": f"with t as ({PARTS}), v as (unpivot t on p_partkey, p_name, p_brand, p_type, p_size into name field value val) select field, count(distinct val) as n from v where val in ('Brand#11', 'Brand#12', '12', '17', 'STEEL', 'nothing') group by field",
    "incidence": "select c_nationkey as source, " + ", ".join(f"bool_or(c_mktsegment = '{s}') as {s}" for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " from customer where c_acctbal > 9000 group by 1",
    "incidence_least": "select c_nationkey as source, " + ", ".join(f"min(c_acctbal) filter (c_mktsegment = '{s}') as {s}" for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " from customer group by 1",
    "adjacency": "select s_nationkey as source, string_agg(s_name, '|' order by s_name) as targets, string_agg(s_suppkey::varchar, '|' order by s_name) as numbers from supplier where s_acctbal > 0 group by 1",
    "trace_summary": f"with {JOBS} select task, count(*) as calls, floor(avg((e - s) / 1e6))::bigint as avg, floor(sum((e - s) / 1e6))::bigint as total from jobs group by task",
    "trace_times": f"""with {JOBS}, g as (select *, min(s) over (partition by user_id) as z, greatest(s - coalesce(max(e) over (partition by user_id order by s, e rows between unbounded preceding and 1 preceding), s), 0) as gap from jobs),
h as (select *, sum(gap) over (partition by user_id order by s, e rows between unbounded preceding and current row) as gone from g)
select event_id, user_id, ((s - z - gone) / 1e6)::double as start_s, ((e - z - gone) / 1e6)::double as end_s from h""",
    "trace_times_with_gaps": f"with {JOBS} select event_id, user_id, ((s - min(s) over (partition by user_id)) / 1e6)::double as start_s, ((e - min(s) over (partition by user_id)) / 1e6)::double as end_s from jobs",
    "sort_by_field": "select n_nationkey::varchar as n_nationkey, n_name, row_number() over (order by n_name, n_nationkey::varchar) as position from nation",
    "page_of_customers": "select c_custkey, c_name, c_acctbal from customer order by c_acctbal desc, c_custkey limit 25 offset 50",
    "page_by_list": f"with {OBC} select o_custkey, len(ks) as n from obc order by len(ks) desc, ks[1] desc, o_custkey limit 40 offset 40",
    "head_rows": "select p_partkey::varchar as p_partkey, p_name from part order by part.p_partkey limit 17",
    "concat_rows": f"with {NAMED} select id, name from a union all select id, name from b",
    "concat_merge": f"with {NAMED} select id, string_agg(name, '|' order by n) as name from (select id, name, 0 as n from a union all select id, name, 1 from b) group by id",
    "overlay": f"with {NAMED} select id, name from b where id not in (select id from a) union all select id, name from a",
    "without_keys": f"with {NAMED} select id, name from b where id not in (select id from a)",
    "common_keys": f"with {NAMED} select id, name from a where id in (select id from b)",
    "edges": f"with {CN} select *, source || '~' || target as pair from cn",
    "edges_of_lists": f"with {LINES} select k as source, p as target, arg_max(f, i) as l_returnflag, arg_max(s, i) as l_linestatus from ln group by k, p",
    "edges_translated": "select c_name as source, n_name as target from customer join nation on c_nationkey = n_nationkey where n_regionkey in (1, 4)",
    "edges_undirected": f"with {UN} select source, target from un",
    "edge_match": f"with {CN} select target as source, source as target, c_mktsegment from cn where target in ('3', '11')",
    "edge_subset": f"with {CN} select cn.* from cn join customer on c_custkey::varchar = source where c_acctbal > 9000 and target in ('1', '2', '3')",
    "edge_subset_undirected": f"with {UN} select source, target from un where source::int < 10 and not (target > source and target::int < 10)",
    "edge_children": f"with {CN} select * from cn where source in ('1', '20', '300')",
    "edge_parents": f"with {CN} select * from cn where target = '7'",
    "edge_neighbours": f"with {NR} select *, 'child' as direction from nr where source in ('1', '2') union all select *, 'parent' from nr where target in ('1', '2')",
    "edge_filter": f"with {CN} select * from cn where c_mktsegment = 'MACHINERY'",
    "kb_traverse": "select c_custkey::varchar as customer, n_nationkey::varchar as nation from customer join nation on c_nationkey = n_nationkey where n_regionkey = 2",
    "kb_condition": "select s_suppkey::varchar as supplier, c_custkey::varchar as customer, n_nationkey::varchar as nation from supplier join customer on s_nationkey = c_nationkey join nation on s_nationkey = n_nationkey where n_regionkey = 1 and c_mktsegment = 'BUILDING'",
    "kb_assignments": "select c_custkey::varchar as customer from customer",
    "kb_assign": "select c_custkey::varchar as customer, c_nationkey::varchar as nation from customer where c_nationkey in (3, 5, 6) and c_mktsegment = 'HOUSEHOLD'",
    "kb_identified": "select c_custkey::varchar as customer, c_nationkey::varchar as nation from customer join nation on c_nationkey = n_nationkey where n_name = (select min(n_name) from nation)",
    "kb_block": "select c_custkey::varchar as customer from customer where c_nationkey in (select s_nationkey from supplier where s_name = 'Supplier#000000001')",
    "csv_scan": "select c_custkey::varchar as c_custkey, c_name, c_acctbal from customer",
    "tsv_round_trip": parallel("string_agg(p, '|' order by i) as l_partkey, string_agg(f, '|' order by i) as l_returnflag, string_agg(s, '|' order by i) as l_linestatus"),
    "tsv_field": "select p_partkey::varchar as p_partkey, p_brand from part where p_brand like 'Brand#2%'",
    "tsv_unmerge": f"with {LINES} select concat_ws(chr(9), k, p, f, s) as value, count(*) as n from ln group by 1",
    "store_round_trip": OBC_SHOWN + " where o_custkey like '13%'",
    "sharded_lookup": CUST + " where customer.c_custkey in (7, 17, 107, 1000007)",
    "packed_positions": "select p as position, s_name from (values (1::bigint), (5), (999999)) v(p) left join supplier on s_suppkey = p",
    "cached_table": OBC_SHOWN,
    "entity_single_property": "select c_name, regexp_extract(c_name, '(\\d+)$', 1)::bigint as number from customer",
    "entity_array_property": "select c_custkey, lower(c_name[1:2]) as initials from customer",
    "entity_multiple_property": "select c_custkey, list_sum([d::bigint for d in regexp_extract_all(c_name, '\\d')])::bigint as digits from customer",
    "entity_to_format": "select o_orderkey, c_name as name from orders join customer on c_custkey = o_custkey",
    "annotations": "select c_custkey::varchar as id, c_mktsegment, c_name, c_name || '|' || c_mktsegment as tags from customer",
    "workflow_graph": "select o_custkey, count(*) filter (o_orderstatus = 'O') as n, count(*) filter (o_orderstatus = 'P') as n_open from orders group by 1 having n > 0",
    "windowed_events": "select date_trunc('day', ts)::timestamp as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
    "event_sessions": """with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hour then 0 else 1 end as new from events),
h as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as s from g) select min(ts)::timestamp as start, user_id, count(*) as n from h group by user_id, s""",
}
