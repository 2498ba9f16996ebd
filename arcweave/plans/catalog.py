"""Registered queries, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as fn
from ..frames import Frame
from ..functions import avg, col, collect, collect_distinct, count, count_distinct, lit, max_, min_, sum_
from ..graph import Hypergraph
from ..operators.infer import Rule
from ..operators.paths import Pattern, all_paths, shortest_path
from ..schema import GraphSchema, Property
from ..sources.tables import read, star
from ..streaming.events import sessions, tumbling

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of a hypergraph under its name, with its SQL."""

    def add(f: Callable[[Hypergraph], Frame | DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            out = f(star(spark, folder))
            return out.to_df() if isinstance(out, Frame) else out

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def raw(sql: str | None = None):
    """Register a function of a session and a folder."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("""select n_name as nation, count(*) as customers, round(sum(c_acctbal), 2) as bal from customer join nation on c_nationkey = n_nationkey
    where c_acctbal > 0 group by 1 order by customers desc, nation limit 10""")
def flagship(g):
    return (
        g.nodes("Customer").filter(col("c_acctbal") > 0).expand("IN_NATION", to="Nation", as_="n").group_by(nation=col("n.n_name"))
        .agg(customers=count(), bal=sum_(col("c_acctbal"))).with_column("bal", fn.round_(col("bal"), 2))
        .order_by(col("customers").desc(), "nation").limit(10).select("nation", "customers", "bal")
    )


# --- scans


@query("select cast(n_nationkey as bigint) as id, n_name as name, 'Nation' as label from nation")
def scan_nodes(g):
    return g.nodes("Nation").select(id=col("id"), name=col("n_name"), label=col("_label"))


@query("select 'IN_REGION' as type, cast(n_nationkey as bigint) as src, cast(n_regionkey as bigint) as dst from nation")
def scan_edges(g):
    return g.edges("IN_REGION").select(type=col("_type"), src=col("_src"), dst=col("_dst"))


@query("select 'LINE_ITEM' as type, 3 as arity, l_quantity as quantity, l_linenumber as line from lineitem")
def scan_hyperedges(g):
    return g.hyperedges("LINE_ITEM").select(type=col("_type"), arity=col("_arity"), quantity=col("l_quantity"), line=col("l_linenumber"))


@query("""select label, count(*) as n from (select 'Region' as label from region union all select 'Nation' from nation union all select 'Customer' from customer
    union all select 'Supplier' from supplier union all select 'Part' from part union all select 'Order' from orders union all select 'Document' from documents
    union all select 'Vector' from embeddings union all select 'Page' from pages union all select 'Turn' from conversations
    union all select 'User' from (select distinct user_id from events)) group by 1""")
def scan_all_labels(g):
    return g.nodes().group_by(label=col("_label")).agg(n=count())


@query("""select type, count(*) as n from (select 'IN_REGION' as type from nation union all select 'IN_NATION' from customer union all select 'IN_NATION' from supplier
    union all select 'PLACED' from orders union all select 'SUPPLIES' from (select distinct l_suppkey, l_partkey from lineitem)
    union all select 'NEXT_TURN' from (select lead(turn) over (partition by conv_id order by turn) x from conversations) where x is not null) group by 1""")
def scan_all_edges(g):
    return g.edges().group_by(type=col("_type")).agg(n=count())


# --- filters


@query("select c_name as name from customer where c_acctbal >= 1000 and c_acctbal < 5000 and c_mktsegment <> 'BUILDING'")
def filter_cmp(g):
    return g.nodes("Customer").filter((col("c_acctbal") >= 1000) & (col("c_acctbal") < 5000) & (col("c_mktsegment") != "BUILDING")).select(name=col("c_name"))


@query("""select c_name as name from customer where (nullif(c_mktsegment, 'BUILDING') = 'MACHINERY' or c_acctbal > 9000)
    and not (nullif(c_mktsegment, 'AUTOMOBILE') = 'HOUSEHOLD' and c_acctbal < 0)""")
def filter_logic3(g):
    seg = col("c_mktsegment")
    return g.nodes("Customer").filter(((seg.nullif("BUILDING") == "MACHINERY") | (col("c_acctbal") > 9000)) & ~((seg.nullif("AUTOMOBILE") == "HOUSEHOLD") & (col("c_acctbal") < 0))).select(name=col("c_name"))


@query("select o_orderkey as id from orders where o_orderpriority in ('1-URGENT', '2-HIGH') and o_orderstatus not in ('F')")
def filter_in(g):
    return g.nodes("Order").filter(col("o_orderpriority").is_in(["1-URGENT", "2-HIGH"]) & col("o_orderstatus").not_in(["F"])).select(id=col("id"))


@query("select p_partkey as id from part where p_size between 10 and 20 and p_retailprice not between 1000 and 1200")
def filter_between(g):
    return g.nodes("Part").filter(col("p_size").between(10, 20) & col("p_retailprice").not_between(1000, 1200)).select(id=col("id"))


@query("select c_custkey as id from customer where nullif(c_mktsegment, 'BUILDING') is null or c_acctbal is null")
def filter_null(g):
    return g.nodes("Customer").filter(col("c_mktsegment").nullif("BUILDING").is_null() | col("c_acctbal").is_null()).select(id=col("id"))


@query("select c_custkey as id from customer where nullif(c_mktsegment, 'BUILDING') is distinct from 'MACHINERY'")
def filter_distinct_from(g):
    return g.nodes("Customer").filter(col("c_mktsegment").nullif("BUILDING").is_distinct_from("MACHINERY")).select(id=col("id"))


@query("select c_custkey as id from customer where nullif(c_mktsegment, 'BUILDING') is not null and c_acctbal is not null")
def filter_not_null(g):
    return g.nodes("Customer").filter(col("c_mktsegment").nullif("BUILDING").is_not_null() & col("c_acctbal").is_not_null()).select(id=col("id"))


@query("""select c_custkey as id, (s = 'MACHINERY') is true as t, (s = 'MACHINERY') is false as f, (s = 'MACHINERY') is null as u, s is not distinct from 'MACHINERY' as same
    from (select *, nullif(c_mktsegment, 'BUILDING') as s from customer)""")
def filter_truth(g):
    s = col("c_mktsegment").nullif("BUILDING")
    is_it = s == "MACHINERY"
    return g.nodes("Customer").select(id=col("id"), t=is_it.is_true(), f=is_it.is_false(), u=is_it.is_unknown(), same=s.is_not_distinct_from("MACHINERY"))


@query("select p_partkey as id from part where p_size > 20 and p_brand = 'Brand#1'")
def filter_param(g):
    return g.nodes("Part").bind(least=20, brand="Brand#1").filter((col("p_size") > fn.param("least")) & (col("p_brand") == fn.param("brand"))).select(id=col("id"))


@query("select n_name as name from nation where false")
def empty_rows(g):
    return g.nodes("Nation").filter(lit(False)).select(name=col("n_name"))


# --- projections


@query("""select p_partkey as id, p_size * 2 + 1 as a, p_partkey // 7 as q, p_partkey % 7 as r, round(p_retailprice / 3, 4) as third, -p_size as neg,
    p_name || '/' || p_brand as label from part""")
def project_expr(g):
    p = g.nodes("Part")
    return p.select(id=col("id"), a=col("p_size") * 2 + 1, q=col("id") / 7, r=col("id") % 7, third=fn.round_(col("p_retailprice") / 3, 4), neg=-col("p_size"), label=fn.concat(col("p_name"), "/", col("p_brand")))


@query("select n_name, cast(n_nationkey as bigint) + 100 as code from nation")
def with_column(g):
    return g.nodes("Nation").with_column("code", col("id") + 100).select("n_name", "code")


@query("select n_name as nation, n_regionkey as region from nation")
def rename(g):
    return g.nodes("Nation").rename({"n_name": "nation", "n_regionkey": "region"}).select("nation", "region")


@query("select r_regionkey, r_name from region")
def wildcard_drop(g):
    return g.nodes("Region", alias="r").drop("r._labels", "r._label", "r._id").select("r.*").rename({"r.r_regionkey": "r_regionkey", "r.r_name": "r_name"})


# --- order, limits


@query("select c_custkey as id, nullif(c_mktsegment, 'BUILDING') as s, row_number() over (order by nullif(c_mktsegment, 'BUILDING') desc nulls last, c_custkey) as n from customer")
def sort_nulls(g):
    """The whole table in order, told by each row's place."""
    rows = g.nodes("Customer").select(s=col("c_mktsegment").nullif("BUILDING"), id=col("id")).order_by(col("s").desc(), "id").to_df()
    out = rows.rdd.zipWithIndex().map(lambda r: (*r[0], r[1] + 1))
    return g.spark.createDataFrame(out, "s string, id long, n long")


@query("""select c_custkey as id, rank() over (partition by c_nationkey order by nullif(c_mktsegment, 'BUILDING') nulls first) as up,
    rank() over (partition by c_nationkey order by nullif(c_mktsegment, 'BUILDING') desc nulls first) as down from customer""")
def window_nulls_first(g):
    c = g.nodes("Customer").with_column("s", col("c_mktsegment").nullif("BUILDING"))
    return c.window(up=("rank", ["c_nationkey"], [col("s").asc().nulls_first()]), down=("rank", ["c_nationkey"], [col("s").desc().nulls_first()])).select("up", "down", id=col("id"))


@query("select o_orderkey as id from orders order by o_orderkey limit 10 offset 25")
def limit_offset(g):
    return g.nodes("Order").select(id=col("id")).order_by("id").offset(25).limit(10)


@query("select c_name as name, c_acctbal as bal from customer order by c_acctbal desc, c_name limit 20")
def topk(g):
    return g.nodes("Customer").select(name=col("c_name"), bal=col("c_acctbal")).order_by("bal", "name", ascending=[False, True]).limit(20)


@query("select id from (select p_partkey as id, p_size from part order by p_size desc, p_partkey desc limit 7)")
def tail_rows(g):
    return g.nodes("Part").tail(7, "p_size", "id").select(id=col("id"))


@query("select n_name as name from nation limit 0")
def limit_zero(g):
    return g.nodes("Nation").select(name=col("n_name")).limit(0)


# --- sets


@query("select n_name as name from nation union all select r_name from region union all select r_name from region")
def union_all(g):
    r = g.nodes("Region").select(name=col("r_name"))
    return g.nodes("Nation").select(name=col("n_name")).union(r).union_all(r)


@query("select c_nationkey as n from customer union select s_nationkey from supplier")
def union_distinct(g):
    return g.nodes("Customer").select(n=col("c_nationkey")).union(g.nodes("Supplier").select(n=col("s_nationkey")), distinct=True)


@query("select c_nationkey as n from customer intersect select s_nationkey from supplier")
def intersect(g):
    return g.nodes("Customer").select(n=col("c_nationkey")).intersect(g.nodes("Supplier").select(n=col("s_nationkey")))


@query("select p_size as n from part except select s_nationkey from supplier")
def except_rows(g):
    return g.nodes("Part").select(n=col("p_size")).except_(g.nodes("Supplier").select(n=col("s_nationkey")))


@query("select distinct c_mktsegment as seg, c_nationkey as n from customer")
def distinct(g):
    return g.nodes("Customer").select(seg=col("c_mktsegment"), n=col("c_nationkey")).distinct()


@query("select p_partkey as id, unnest(string_split(p_name, ' ')) as word from part")
def explode(g):
    return g.nodes("Part").explode(col("p_name").split(" "), "word").select(id=col("id"), word=col("word"))


@query("select r_name as r, s_suppkey as s from region, supplier where r_regionkey < s_nationkey")
def cross(g):
    return g.nodes("Region").cross(g.nodes("Supplier")).filter(col("r_regionkey") < col("s_nationkey")).select(r=col("r_name"), s=col("Supplier.id"))


# --- aggregates


@query("select count(*) as n, count(distinct c_nationkey) as nations, round(sum(c_acctbal), 2) as total, round(avg(c_acctbal), 4) as mean, min(c_acctbal) as low, max(c_name) as last from customer")
def agg_global(g):
    out = g.nodes("Customer").agg(n=count(), nations=count_distinct("c_nationkey"), total=sum_("c_acctbal"), mean=avg("c_acctbal"), low=min_("c_acctbal"), last=max_("c_name"))
    return out.select("n", "nations", "low", "last", total=fn.round_(col("total"), 2), mean=fn.round_(col("mean"), 4))


@query("""select l_returnflag as flag, l_linestatus as status, count(*) as n, cast(sum(l_quantity) as bigint) as quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue,
    round(avg(l_discount), 6) as discount from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2""")
def agg_group(g):
    import datetime

    rows = g.hyperedges("LINE_ITEM").filter(col("l_shipdate") <= datetime.datetime(1998, 9, 2))
    out = rows.group_by(flag=col("l_returnflag"), status=col("l_linestatus")).agg(n=count(), quantity=sum_("l_quantity"), revenue=sum_(col("l_extendedprice") * (1 - col("l_discount"))), discount=avg("l_discount"))
    return out.select("flag", "status", "n", quantity=col("quantity").cast("int"), revenue=fn.round_(col("revenue"), 2), discount=fn.round_(col("discount"), 6))


@query("select o_orderpriority as p, count(distinct o_custkey) as customers, count(o_orderkey) as n from orders group by 1")
def agg_count_distinct(g):
    return g.nodes("Order").group_by(p=col("o_orderpriority")).agg(customers=count_distinct("o_custkey"), n=count("o_orderkey"))


@query("""select r_name as region, array_to_string(list_sort(list(n_name)), ',') as nations, array_to_string(list_sort(list(distinct n_name[1:1])), ',') as letters from nation join region on n_regionkey = r_regionkey group by 1""")
def agg_collect(g):
    out = g.nodes("Nation").expand("IN_REGION", to="Region").group_by(region=col("r_name")).agg(nations=collect("n_name"), letters=collect_distinct(col("n_name").substring(1, 1)))
    return out.with_column("nations", fn.call("JOIN", lambda x: F.array_join(x, ","), col("nations"))).with_column("letters", fn.call("JOIN", lambda x: F.array_join(x, ","), col("letters")))


@query("select c_nationkey as n, arg_min(c_name, c_custkey) as first, arg_max(c_name, c_custkey) as last from customer group by 1")
def agg_first_last(g):
    return g.nodes("Customer").group_by(n=col("c_nationkey")).agg(first=fn.first("c_name", by=col("id")), last=fn.last("c_name", by=col("id")))


@query("select p_brand as brand, round(stddev(p_retailprice), 4) as sd, round(stddev_pop(p_retailprice), 4) as sdp, round(var_samp(p_retailprice), 2) as v, round(var_pop(p_retailprice), 2) as vp from part group by 1")
def agg_stats(g):
    out = g.nodes("Part").group_by(brand=col("p_brand")).agg(sd=fn.stddev("p_retailprice"), sdp=fn.stddev_pop("p_retailprice"), v=fn.variance("p_retailprice"), vp=fn.variance_pop("p_retailprice"))
    return out.select("brand", sd=fn.round_(col("sd"), 4), sdp=fn.round_(col("sdp"), 4), v=fn.round_(col("v"), 2), vp=fn.round_(col("vp"), 2))


@query("""select p_brand as brand, round(median(p_retailprice), 4) as med, round(quantile_cont(p_retailprice, 0.9), 4) as p90 from part group by 1""")
def agg_percentile(g):
    out = g.nodes("Part").group_by(brand=col("p_brand")).agg(med=fn.median("p_retailprice"), p90=fn.percentile("p_retailprice", 0.9))
    return out.select("brand", med=fn.round_(col("med"), 4), p90=fn.round_(col("p90"), 4))


@query("""select r_name as region, string_agg(n_name, '|' order by n_name) as names from nation join region on n_regionkey = r_regionkey group by 1""")
def agg_string(g):
    return g.nodes("Nation").expand("IN_REGION", to="Region").group_by(region=col("r_name")).agg(names=fn.string_agg("n_name", "|"))


@query("""select c_nationkey as n, min(s) as mode from (select c_nationkey, c_mktsegment as s, rank() over (partition by c_nationkey order by count(*) desc) r from customer group by 1, 2) where r = 1 group by 1""")
def agg_mode(g):
    return g.nodes("Customer").group_by(n=col("c_nationkey")).agg(mode=fn.mode("c_mktsegment"))


@query("select cast(sum(distinct p_size) as bigint) as s, round(avg(distinct p_size), 6) as a from part")
def agg_distinct_flag(g):
    return g.nodes("Part").agg(s=sum_("p_size", distinct=True), a=avg("p_size", distinct=True)).select(s=col("s"), a=fn.round_(col("a"), 6))


@query("select nullif(c_mktsegment, 'BUILDING') as s, count(*) as n from customer group by 1 having count(*) > 10")
def having(g):
    return g.nodes("Customer").group_by(s=col("c_mktsegment").nullif("BUILDING")).agg(n=count()).filter(col("n") > 10)


@query("select n, id, bal from (select c_nationkey as n, c_custkey as id, c_acctbal as bal, row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) as r from customer) where r <= 3")
def top_n_per_group(g):
    return g.nodes("Customer").top_n_per_group(3, ["c_nationkey"], ["c_acctbal", "id"], [False, True]).select(n=col("c_nationkey"), id=col("id"), bal=col("c_acctbal"))


@query("select c_nationkey as n, c_custkey as id from (select *, row_number() over (partition by c_nationkey order by c_acctbal, c_custkey) r from customer) where r = 1")
def group_first_row(g):
    return g.nodes("Customer").select("c_nationkey", "c_acctbal", id=col("id")).group_by("c_nationkey").first("c_acctbal", "id").select(n=col("c_nationkey"), id=col("id"))


@query("select c_nationkey as n, c_custkey as id from (select *, row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey desc) r from customer) where r = 1")
def group_last_row(g):
    return g.nodes("Customer").select("c_nationkey", "c_acctbal", id=col("id")).group_by("c_nationkey").last("c_acctbal", "id").select(n=col("c_nationkey"), id=col("id"))


@query("select c_mktsegment as seg, count(*) as n from customer group by 1")
def group_count(g):
    return g.nodes("Customer").group_by(seg=col("c_mktsegment")).count("n")


@query("select n_nationkey * 2 as double, n_regionkey + 1 as more, n_name as name from nation")
def with_columns(g):
    return g.nodes("Nation").with_columns(double=col("n_nationkey") * 2, more=col("n_regionkey") + 1).select("double", "more", name=col("n_name"))


@query("select distinct c_mktsegment as seg, c_nationkey as n from customer")
def unique_by(g):
    return g.nodes("Customer").unique("c_mktsegment", "c_nationkey").select(seg=col("c_mktsegment"), n=col("c_nationkey"))


@query("select c_nationkey as n, round(sqrt(sum(c_acctbal * c_acctbal)), 2) as norm from customer group by 1")
def udaf_norm(g):
    """A registered aggregate of Spark functions."""
    fn.register_udf("euclid", lambda x: F.sqrt(F.sum(x * x)))
    return g.nodes("Customer").group_by(n=col("c_nationkey")).agg(norm=fn.udaf("euclid", col("c_acctbal"))).with_column("norm", fn.round_(col("norm"), 2))


@query("select p_partkey as id, p_size * 3 as v from part")
def udf_call(g):
    fn.register_udf("thrice", lambda x: x * 3)
    return g.nodes("Part").select(id=col("id"), v=fn.udf("thrice", col("p_size")))


@query("""select o_orderkey as id, rank() over (partition by o_custkey order by o_orderdate) as r, lag(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as prev,
    count(*) over (partition by o_custkey) as n from orders""")
def window_ranks(g):
    o = g.nodes("Order").window(r=("rank", ["o_custkey"], ["o_orderdate"]), prev=(("lag", col("o_orderkey")), ["o_custkey"], ["o_orderdate", "o_orderkey"]), n=(count(), ["o_custkey"], []))
    return o.select("r", "prev", "n", id=col("id"))


# --- traversal


@query("select c_custkey as c, n_name as nation from customer join nation on c_nationkey = n_nationkey")
def expand_out(g):
    return g.nodes("Customer").expand("IN_NATION", to="Nation").select(c=col("Customer.id"), nation=col("n_name"))


@query("select n_name as nation, 'Customer' as label, count(*) as n from customer join nation on c_nationkey = n_nationkey group by 1 union all select n_name, 'Supplier', count(*) from supplier join nation on s_nationkey = n_nationkey group by 1")
def expand_in(g):
    return g.nodes("Nation").expand("IN_NATION", direction="in", as_="x").group_by(nation=col("n_name"), label=col("x._label")).agg(n=count())


@query("""with e as (select conv_id * 1000000 + turn as s, lead(conv_id * 1000000 + turn) over (partition by conv_id order by turn) as d from conversations)
    select s as a, d as b from e where d is not null union all select d, s from e where d is not null""")
def expand_both(g):
    return g.nodes("Turn").expand("NEXT_TURN", to="Turn", direction="both", as_="b").select(a=col("Turn.id"), b=col("b.id"))


@query("select c_custkey as c, o_orderkey as o, o_orderpriority as p from customer join orders on c_custkey = o_custkey where o_orderpriority = '1-URGENT'")
def expand_edge_pred(g):
    return g.nodes("Customer").expand("PLACED", to="Order", as_="o", edge_as="e", edge_where=col("o_orderpriority") == "1-URGENT").select(c=col("Customer.id"), o=col("o.id"), p=col("e.o_orderpriority"))


@query("select c_custkey as c, o_orderkey as o from customer join orders on c_custkey = o_custkey where o_totalprice > 300000 and c_acctbal > 0")
def expand_target_pred(g):
    return g.nodes("Customer").filter(col("c_acctbal") > 0).expand("PLACED", to="Order", as_="o", to_where=col("o_totalprice") > 300000).select(c=col("Customer.id"), o=col("o.id"))


@query("""select r_name as region, count(*) as orders, count(distinct c_custkey) as customers from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
    join region on n_regionkey = r_regionkey group by 1""")
def expand_chain3(g):
    chain = g.nodes("Order").expand("PLACED", to="Customer", direction="in").expand("IN_NATION", to="Nation").expand("IN_REGION", to="Region")
    return chain.group_by(region=col("r_name")).agg(orders=count(), customers=count_distinct(col("Customer.id")))


@query("select s_suppkey as s, n_name as nation, count(distinct l_partkey) as parts from supplier join nation on s_nationkey = n_nationkey join lineitem on l_suppkey = s_suppkey group by 1, 2")
def expand_branch(g):
    rows = g.nodes("Supplier").expand("IN_NATION", to="Nation").expand("SUPPLIES", to="Part", from_="Supplier", as_="p")
    return rows.group_by(s=col("Supplier.id"), nation=col("n_name")).agg(parts=count_distinct(col("p.id")))


@query("""select c_custkey as c, o_orderkey as o from customer left join orders on c_custkey = o_custkey and o_totalprice > 400000""")
def optional_expand(g):
    return g.nodes("Customer").optional_expand("PLACED", to="Order", as_="o", to_where=col("o_totalprice") > 400000).select(c=col("Customer.id"), o=col("o.id"))


@query("""select 'IN_NATION' as type, s_suppkey as s, cast(s_nationkey as bigint) as x from supplier union all select distinct 'SUPPLIES', l_suppkey, l_partkey from lineitem""")
def expand_any_type(g):
    return g.nodes("Supplier").expand(["IN_NATION", "SUPPLIES"], as_="x", edge_as="e").select(type=col("e._type"), s=col("Supplier.id"), x=col("x.id"))


_TURNS = "with recursive e as (select conv_id * 1000000 + turn as s, lead(conv_id * 1000000 + turn) over (partition by conv_id order by turn) as d from conversations)"


@query(f"{_TURNS} select a.s as a, b.d as b from e a join e b on a.d = b.s where b.d is not null")
def expand_hops2(g):
    return g.nodes("Turn").expand("NEXT_TURN", to="Turn", hops=2, as_="b", path_properties=[]).select(a=col("Turn.id"), b=col("b.id"))


_REACH = f"""{_TURNS}, w as (select s as a, d as b, 1 as n from e where d is not null union all select w.a, e.d, n + 1 from w join e on w.b = e.s where e.d is not null and n < {{}})"""


@query(f"{_REACH.format(3)} select a, b, n from w union all select conv_id * 1000000 + turn, conv_id * 1000000 + turn, 0 from conversations")
def expand_hops_range(g):
    return g.nodes("Turn").expand("NEXT_TURN", to="Turn", hops=(0, 3), as_="b", path_properties=[]).select(a=col("Turn.id"), b=col("b.id"), n=fn.path_length(col("_path")))


@query(f"{_REACH.format(100000)} select a, b, n from w")
def expand_unbounded(g):
    return g.nodes("Turn").expand("NEXT_TURN", to="Turn", hops=(1, None), as_="b", path_properties=[]).select(a=col("Turn.id"), b=col("b.id"), n=fn.path_length(col("_path")))


@query("select cast(n_nationkey as bigint) as id, cast((select count(*) from customer where c_nationkey = n_nationkey) + (select count(*) from supplier where s_nationkey = n_nationkey) + 1 as bigint) as d from nation")
def degree(g):
    return g.nodes("Nation").degree(as_="d").select(id=col("id"), d=col("d"))


@query("""select cast(n_nationkey as bigint) as n, x as id, 'IN_NATION' as t from nation join (select c_custkey x, c_nationkey k from customer union all select s_suppkey, s_nationkey from supplier) on k = n_nationkey
    where n_regionkey = 1""")
def in_edges(g):
    return g.nodes("Nation").filter(col("n_regionkey") == 1).in_edges("IN_NATION", as_="e").select(n=col("Nation.id"), id=col("e._src"), t=col("e._type"))


@query("select c_custkey as id, o_orderkey as o from customer join orders on c_custkey = o_custkey where c_acctbal < 0")
def out_edges(g):
    return g.nodes("Customer").filter(col("c_acctbal") < 0).out_edges("PLACED", as_="e").select(id=col("Customer.id"), o=col("e._dst"))


@query("select n_regionkey as r, count(*) as n from nation join customer on c_nationkey = n_nationkey group by 1 union all select n_regionkey, count(*) from nation join supplier on s_nationkey = n_nationkey group by 1")
def neighbors(g):
    x = g.nodes("Nation").neighbors("in").filter(col("neighbor._label").is_in(["Customer", "Supplier"]))
    return x.group_by(r=col("Nation.n_regionkey"), l=col("neighbor._label")).agg(n=count()).select("r", "n")


@query("select c_custkey as id from customer union all select cast(n_nationkey as bigint) from customer join nation on c_nationkey = n_nationkey")
def endpoints(g):
    e = g.edges("IN_NATION").filter(col("_src_label") == "Customer")
    return e.endpoints("both", as_="x").filter(col("x._label") != "Supplier").select(id=col("x.id"))


@query("select o_orderkey as id, c_name as name from orders join customer on o_custkey = c_custkey")
def edge_source(g):
    return g.edges("PLACED").source().select(id=col("PLACED._dst"), name=col("c_name"))


# --- hyperedges


@query("select p_brand as brand, cast(sum(l_quantity) as bigint) as quantity, count(*) as n from lineitem join part on l_partkey = p_partkey group by 1")
def role_expand(g):
    return g.hyperedges("LINE_ITEM").expand("part", as_="p").group_by(brand=col("p.p_brand")).agg(quantity=sum_(col("LINE_ITEM.l_quantity")), n=count()).with_column("quantity", col("quantity").cast("int"))


@query("""select p_brand as brand, s_nationkey as nation, count(*) as n from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey where p_size > s_nationkey group by 1, 2""")
def role_pair(g):
    rows = g.hyperedges("LINE_ITEM").expand("part", as_="p").expand("supplier", as_="s").filter(col("p.p_size") > col("s.s_nationkey"))
    return rows.group_by(brand=col("p.p_brand"), nation=col("s.s_nationkey")).agg(n=count())


@query("select l_orderkey as o, l_linenumber as line from lineitem where l_suppkey in (1, 3)")
def where_role_literal(g):
    return g.hyperedges("LINE_ITEM").where_role("supplier", [1, 3]).select(o=col("l_orderkey"), line=col("l_linenumber"))


@query("select count(*) as n, cast(sum(l_quantity) as bigint) as quantity from lineitem join supplier on l_suppkey = s_suppkey where s_acctbal > 5000")
def where_role_frame(g):
    rich = g.nodes("Supplier").filter(col("s_acctbal") > 5000)
    return g.hyperedges("LINE_ITEM").where_role("supplier", rich).agg(n=count(), quantity=sum_("l_quantity")).select(n=col("n"), quantity=col("quantity").cast("int"))


@query("""select count(*) as n, count(distinct o) as orders from (select l_orderkey as o from lineitem where l_suppkey in (1, 3)
    union all select o_orderkey from orders where o_custkey in (1, 3))""")
def where_role_mixed(g):
    """One role of two tables: a column of line items, rows of an incidence table of orders. Line items are there as often as they come."""
    lines = g.hyper_tables[0].data.select(F.col("l_orderkey").alias("o"), "l_suppkey")
    orders = g.edges("PLACED").select(e=col("_id"), c=col("_src")).to_df()
    inc = orders.select(F.col("e").alias("edge_id"), F.lit(0).alias("ord"), F.lit("by").alias("role"), F.lit("node").alias("target_kind"), F.lit("Supplier").alias("target_label"), F.col("c").alias("target_id"))
    both = Hypergraph(g.spark).with_nodes("Supplier", g.tables_of("Supplier")[0].data)
    both = both.with_hyperedges("SALE", lines, [("by", "Supplier", "l_suppkey")]).with_hyperedges("SALE", orders.select(F.col("e").alias("_id"), F.col("e").alias("o")), incidence=inc)
    return both.hyperedges("SALE").where_role("by", [1, 3]).agg(n=count(), orders=count_distinct("o"))


@query("select s_suppkey as s, count(*) as n, max(l_linenumber) as top from supplier join lineitem on l_suppkey = s_suppkey group by 1")
def materialize_hyperedge(g):
    return g.nodes("Supplier").hyperedges_of("LINE_ITEM", "supplier").group_by(s=col("Supplier.id")).agg(n=count(), top=max_("l_linenumber"))


@query("select s_suppkey as s, count(*) as n, count(distinct l_partkey) as parts from supplier join lineitem on l_suppkey = s_suppkey join part on l_partkey = p_partkey group by 1")
def node_role_expand(g):
    return g.nodes("Supplier").expand_role("LINE_ITEM", "supplier", "part", as_="p").group_by(s=col("Supplier.id")).agg(n=count(), parts=count_distinct(col("p.id")))


@query("select role, count(*) as n from lineitem, (values ('order'), ('part'), ('supplier')) r(role) group by 1")
def incidence(g):
    return g.hyper_tables[0].bindings().groupBy("role").agg(F.count(F.lit(1)).alias("n"))


@query("""select c_mktsegment as seg, count(*) as n, count(distinct o_orderkey) as sales from lineitem join orders on l_orderkey = o_orderkey
    join customer on o_custkey = c_custkey group by 1""")
def meta_edge(g):
    """Line items bind orders, which are hyperedges that bind customers."""
    sales = g.with_hyperedges("SALE", g.tables_of("Order")[0].data.drop("_id"), [("customer", "Customer", "o_custkey")], id="o_orderkey")
    sales = sales.with_hyperedges("SHIPMENT", g.hyper_tables[0].data.drop("_id"), [("sale", "SALE", "l_orderkey", "hyperedge"), ("part", "Part", "l_partkey")])
    rows = sales.hyperedges("SHIPMENT").expand_hyperedge("sale", as_="s").expand("customer", as_="c")
    return rows.group_by(seg=col("c.c_mktsegment")).agg(n=count(), sales=count_distinct(col("s._id")))


@query("""select c_mktsegment as seg, count(*) as n from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey group by 1""")
def meta_edge_incidence(g):
    """As meta_edge, with the bindings as rows."""
    lines = g.hyper_tables[0].data
    inc = lines.select(F.col("_id").alias("edge_id"), F.lit(0).alias("ord"), F.lit("sale").alias("role"), F.lit("hyperedge").alias("target_kind"), F.lit("SALE").alias("target_label"), F.col("l_orderkey").alias("target_id"))
    sales = g.with_hyperedges("SALE", g.tables_of("Order")[0].data.drop("_id"), [("customer", "Customer", "o_custkey")], id="o_orderkey")
    rows = sales.with_hyperedges("SHIPMENT", lines.select("_id"), incidence=inc).hyperedges("SHIPMENT").expand_hyperedge("sale", as_="s")
    return rows.expand("customer", as_="c").group_by(seg=col("c.c_mktsegment")).agg(n=count())


@query("select role from (values ('order'), ('part'), ('supplier')) r(role)")
def role_names(g):
    return g.spark.createDataFrame([(r,) for r in g.hyperedges("LINE_ITEM").roles()], "role string")


# --- subqueries


@query("select c_custkey as id from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 400000)")
def exists_semi(g):
    big = g.nodes("Customer").expand("PLACED", to="Order", to_where=col("o_totalprice") > 400000)
    return g.nodes("Customer").filter(fn.exists(big)).select(id=col("id"))


@query("select c_custkey as id from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def not_exists_anti(g):
    return g.nodes("Customer").filter(~fn.exists(g.nodes("Customer").expand("PLACED"))).select(id=col("id"))


@query("select c_custkey as id from customer where c_acctbal < 0 or exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')")
def exists_in_or(g):
    open_ = g.nodes("Order").filter(col("o_orderstatus") == "P")
    return g.nodes("Customer").filter((col("c_acctbal") < 0) | fn.exists(open_, on=("Customer.id", "Order.o_custkey"))).select(id=col("id"))


@query("select c_custkey as id from customer where c_acctbal > (select avg(c_acctbal) from customer)")
def scalar_subquery(g):
    mean = g.nodes("Customer").agg(m=avg("c_acctbal"))
    return g.nodes("Customer").filter(col("c_acctbal") > fn.scalar(mean)).select(id=col("id"))


# --- paths


@query(f"{_REACH.format(100000)} select a, b, min(n) as length, count(*) as paths from w group by a, b")
def shortest(g):
    found = shortest_path(g.nodes("Turn"), g.nodes("Turn"), "NEXT_TURN", direction="out", path_properties=[])
    return found.group_by(a=col("start.id"), b=col("end.id")).agg(length=min_("length"), paths=count())


@query(f"{_REACH.format(4)} select a, b, n as length from w where n >= 2")
def paths_between(g):
    found = all_paths(g.nodes("Turn"), g.nodes("Turn"), "NEXT_TURN", min_hops=2, max_hops=4, direction="out", path_properties=[])
    return found.select(a=col("start.id"), b=col("end.id"), length=col("length"))


@query(f"""{_TURNS}, t as (select conv_id * 1000000 + turn as i, length(text) as l from conversations), w as (select s as a, d as b, least(x.l, y.l) as m, 1 as n from e join t x on x.i = s join t y on y.i = d
    union all select w.a, e.d, least(m, t.l), n + 1 from w join e on w.b = e.s join t on t.i = e.d where n < 3) select a, b from w where m > 20""")
def path_predicate(g):
    rows = g.nodes("Turn").expand("NEXT_TURN", to="Turn", hops=(1, 3), as_="b", path_properties=["text"])
    return rows.filter(fn.all_(fn.nodes(col("_path")), fn.call("LENGTH", F.length, col("text")) > 20)).select(a=col("Turn.id"), b=col("b.id"))


@query(f"{_REACH.format(3)} select a as start, b as finish, n as steps, a as head, b as tail, n >= 2 as long, a % 1000000 <> 0 as none_first from w")
def path_functions(g):
    p = col("_path")
    rows = g.nodes("Turn").expand("NEXT_TURN", to="Turn", hops=(1, 3), as_="b", path_properties=[])
    first = fn.call("IS_FIRST", lambda x: x % 1_000_000 == 0, col("_id"))
    return rows.select(
        start=col("Turn.id"), finish=col("b.id"), steps=fn.relationships(p).size().cast("int"), head=fn.start_node(p), tail=fn.end_node(p),
        long=fn.nodes(p).size() > 2, none_first=fn.none_(fn.nodes(p), first),
    )


@query(f"{_REACH.format(3)} select a, b from w where a % 1000000 = 0")
def path_any(g):
    first = fn.call("IS_FIRST", lambda x: x % 1_000_000 == 0, col("_id"))
    rows = g.nodes("Turn").expand("NEXT_TURN", to="Turn", hops=(1, 3), as_="b", path_properties=[])
    return rows.filter(fn.any_(fn.nodes(col("_path")), first)).select(a=col("Turn.id"), b=col("b.id"))


@query("select o_custkey as a, o_orderkey as b, 'PLACED' as t from orders")
def edge_ends(g):
    e = g.edges("PLACED", alias="e")
    return e.select(a=fn.start_node(col("e")), b=fn.end_node(col("e")), t=fn.type_(col("e")))


@query("""select c_custkey as c, r_name as region from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey""")
def pattern_match(g):
    p = Pattern().start("Customer").via("IN_NATION", to="Nation").via("IN_REGION").end("Region")
    return g.match(p).select(c=col("start.id"), region=col("r_name"))


# --- shapes of queries


@query("select c_custkey as c, s_suppkey as s from customer join supplier on c_nationkey = s_nationkey")
def cycle_by_nation(g):
    """Two ways to one node: customers and suppliers that meet in a nation."""
    there = g.nodes("Customer").expand("IN_NATION", to="Nation", as_="n")
    back = g.nodes("Supplier", alias="s").expand("IN_NATION", to="Nation", as_="m")
    return there.meet(back, [("n.id", "m.id")]).select(c=col("Customer.id"), s=col("s.id"))


@query("select type, count(*) as n, count(distinct src) as starts from (select 'IN_NATION' as type, s_suppkey as src from supplier union all select distinct 'SUPPLIES', l_suppkey, l_partkey from lineitem) group by 1".replace("select distinct 'SUPPLIES', l_suppkey, l_partkey from lineitem", "select 'SUPPLIES', l_suppkey from (select distinct l_suppkey, l_partkey from lineitem)"))
def group_on_type(g):
    return g.nodes("Supplier").expand(["IN_NATION", "SUPPLIES"], edge_as="e").group_by(type=fn.type_(col("e"))).agg(n=count(), starts=count_distinct(col("Supplier.id")))


@query("""select n_name as nation, count(*) as suppliers from (select c_nationkey k from customer group by 1 order by count(*) desc, c_nationkey limit 3) join nation on n_nationkey = k
    join supplier on s_nationkey = k group by 1""")
def aggregate_then_match(g):
    top = g.nodes("Customer").group_by(k=col("c_nationkey")).agg(n=count()).order_by("n", "k", ascending=[False, True]).limit(3)
    nations = g.nodes("Nation").filter(fn.exists(top, on=("Nation.n_nationkey", "k")))
    return nations.expand("IN_NATION", direction="in", to="Supplier", as_="s").group_by(nation=col("n_name")).agg(suppliers=count())


@query(f"{_REACH.format(3)} select x.a as a, y.b as b, x.n as first, y.n as second from w x join w y on x.b = y.a")
def two_variable_segments(g):
    one = g.nodes("Turn").expand("NEXT_TURN", to="Turn", hops=(1, 3), as_="m", path_properties=[]).select(a=col("Turn.id"), m=col("m.id"), first=fn.path_length(col("_path")))
    two = g.nodes("Turn").expand("NEXT_TURN", to="Turn", hops=(1, 3), as_="b", path_properties=[]).select(m=col("Turn.id"), b=col("b.id"), second=fn.path_length(col("_path")))
    return one.to_df().join(two.to_df(), "m").select("a", "b", "first", "second")


@query(f"{_REACH.format(100000)} select a, max(n) as longest from w group by a")
def longest_path(g):
    walks = g.nodes("Turn").expand("NEXT_TURN", to="Turn", hops=(1, None), as_="b", path_properties=[])
    return walks.group_by(a=col("Turn.id")).agg(longest=max_(fn.path_length(col("_path"))))


@query("select n_name as name from nation order by length(n_name) desc, n_name limit 5")
def sort_by_expression(g):
    return g.nodes("Nation").order_by(col("n_name").length().desc(), "n_name").limit(5).select(name=col("n_name"))


@query("select cast(r_regionkey as bigint) as id, 2 as n from region")
def count_of_properties(g):
    return g.nodes("Region").select(id=col("id"), n=fn.properties(col("Region")).keys().size().cast("int"))


@query("select a.p_partkey as a, b.p_partkey as b from part a join part b on a.p_brand = b.p_brand and a.p_partkey < b.p_partkey where a.p_size = b.p_size or a.p_retailprice = b.p_retailprice")
def any_shared_value(g):
    """Pairs of one brand of which any other property is the same."""
    a, b = g.nodes("Part", alias="a"), g.nodes("Part", alias="b")
    brand, size, price = [(f"a.{c}", f"b.{c}") for c in ("p_brand", "p_size", "p_retailprice")]
    same_size = a.meet(b, [brand, size]).filter(col("a.id") < col("b.id"))
    # Pairs of one size as well are among the others.
    same_price = a.meet(b, [brand, price]).filter((col("a.id") < col("b.id")) & ~fn.coalesce(col("a.p_size") == col("b.p_size"), lit(False)))
    pairs = [x.select(a=col("a.id"), b=col("b.id")) for x in (same_size, same_price)]
    return pairs[0].union(pairs[1])


# --- inference


_TOLD = Rule(("FOLLOWS", "x", "y"), (("NEXT_TURN", "x", "y"),), "step")
_CLOSED = Rule(("FOLLOWS", "x", "z"), (("FOLLOWS", "x", "y"), ("NEXT_TURN", "y", "z")), "close")


@query("select c_custkey as a, cast(n_regionkey as bigint) as b from customer join nation on c_nationkey = n_nationkey")
def infer_standard(g):
    h = g.infer([Rule(("LIVES_IN", "c", "r"), (("IN_NATION", "c", "n"), ("IN_REGION", "n", "r")), "lives")], mode="standard")
    return h.edges("LIVES_IN").filter(col("_src_label") == "Customer").select(a=col("_src"), b=col("_dst"))


@query(f"{_REACH.format(3)} select a, b from w")
def infer_bounded(g):
    return g.infer([_TOLD, _CLOSED], mode="bounded", rounds=3).edges("FOLLOWS").select(a=col("_src"), b=col("_dst"))


@query(f"{_REACH.format(100000)} select a, b from w")
def infer_fixpoint(g):
    # Joining what is derived with itself doubles the reach of each round.
    twice = Rule(("FOLLOWS", "x", "z"), (("FOLLOWS", "x", "y"), ("FOLLOWS", "y", "z")), "double")
    return g.infer([_TOLD, twice]).edges("FOLLOWS").select(a=col("_src"), b=col("_dst"))


# --- functions


@query("""select p_partkey as id, length(p_name) as l, upper(p_name) as u, lower(p_brand) as lo, trim('  ' || p_name || ' ') as t, ltrim('  x') as lt, rtrim('x  ') as rt, substring(p_name, 2, 4) as s,
    substring(p_name, 3) as s2, replace(p_name, 'e', 'E') as r, p_name like '%e%' as lk, starts_with(p_name, 'a') as sw, ends_with(p_name, 'e') as ew, contains(lower(p_brand), 'brand') as ct,
    left(p_name, 3) as lf, right(p_name, 3) as rg, reverse(p_name) as rv, cast(p_size as varchar) as ts from part""")
def fn_string(g):
    p, b = col("p_name"), col("p_brand")
    return g.nodes("Part").select(
        id=col("id"), l=p.length(), u=p.upper(), lo=b.lower(), t=fn.concat("  ", p, " ").trim(), lt=lit("  x").ltrim(), rt=lit("x  ").rtrim(), s=p.substring(2, 4), s2=p.substring(3), r=p.replace("e", "E"),
        lk=p.like("%e%"), sw=p.starts_with("a"), ew=p.ends_with("e"), ct=b.contains("BRAND", case_sensitive=False), lf=fn.left(p, 3), rg=fn.right(p, 3), rv=fn.reverse(p), ts=fn.to_string(col("p_size")),
    )


@query("select c_custkey as id, regexp_full_match(c_name, 'Customer#0*[1-5][0-9]*') as m from customer")
def fn_regex(g):
    return g.nodes("Customer").select(id=col("id"), m=col("c_name").matches("Customer#0*[1-5][0-9]*"))


@query("select page_id as id, len(string_split(url, '.')) as n, string_split(url, '.')[2] as second from pages")
def fn_split(g):
    parts = col("url").split(".")
    return g.nodes("Page").select(id=col("id"), n=parts.size(), second=parts.get(1))


@query("""select c_custkey as id, abs(c_acctbal) as a, cast(ceil(c_acctbal) as bigint) as c, cast(floor(c_acctbal) as bigint) as f, round(c_acctbal, 1) as r, round(sqrt(abs(c_acctbal)), 6) as s, round(power(abs(c_acctbal) / 1000, 2), 6) as p,
    round(ln(abs(c_acctbal) + 1), 6) as l, round(log10(abs(c_acctbal) + 1), 6) as l10, round(exp(c_acctbal / 10000), 6) as e, cast(sign(c_acctbal) as double) as g from customer""")
def fn_math(g):
    b = col("c_acctbal")
    return g.nodes("Customer").select(
        id=col("id"), a=fn.abs_(b), c=fn.ceil(b), f=fn.floor(b), r=fn.round_(b, 1), s=fn.round_(fn.sqrt(fn.abs_(b)), 6), p=fn.round_(fn.power(fn.abs_(b) / 1000, 2), 6),
        l=fn.round_(fn.ln(fn.abs_(b) + 1), 6), l10=fn.round_(fn.log10(fn.abs_(b) + 1), 6), e=fn.round_(fn.exp(b / 10000), 6), g=fn.sign(b),
    )


@query("""select o_orderkey as id, cast(cast(o_orderdate as date) as varchar) as d, cast(year(o_orderdate) as int) as y, cast(month(o_orderdate) as int) as m, cast(day(o_orderdate) as int) as dd, cast(hour(o_orderdate) as int) as h,
    date_diff('day', timestamp '1990-01-01', o_orderdate) as days, strftime(cast(o_orderdate as date) + 30, '%Y-%m-%d') as later, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') as first from orders""")
def fn_date(g):
    t = col("o_orderdate")
    return g.nodes("Order").select(
        id=col("id"), d=fn.to_string(fn.date(t)), y=fn.year(t), m=fn.month(t), dd=fn.day(t), h=fn.hour(t), days=fn.date_diff(fn.date(t), fn.date(lit("1990-01-01"))).cast("int"), later=fn.to_string(fn.date_add(t, 30)), first=fn.to_string(fn.date(fn.date_trunc("month", t))),
    )


@query("select c_custkey as id, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') as a, ifnull(nullif(c_nationkey, 3), -1) as b, c_acctbal is null as c from customer")
def fn_null(g):
    return g.nodes("Customer").select(id=col("id"), a=fn.coalesce(col("c_mktsegment").nullif("BUILDING"), "none"), b=fn.ifnull(col("c_nationkey").nullif(3), -1), c=col("c_acctbal").is_null())


@query("select c_custkey as id, cast(c_custkey as varchar) as s, cast(c_nationkey as double) as f, try_cast(c_mktsegment as bigint) as t, 'float' as k from customer")
def fn_cast(g):
    return g.nodes("Customer").select(id=col("id"), s=col("id").cast("string"), f=col("c_nationkey").cast("float"), t=col("c_mktsegment").try_cast("int"), k=fn.typeof(col("c_acctbal")))


@query("""select c_custkey as id, case when c_acctbal < 0 then 'debt' when c_acctbal < 5000 then 'some' else 'rich' end as k, case c_mktsegment when 'BUILDING' then 1 when 'MACHINERY' then 2 else 0 end as s,
    case when c_nationkey > 10 then 'hi' else 'lo' end as i from customer""")
def fn_case(g):
    b = col("c_acctbal")
    return g.nodes("Customer").select(id=col("id"), k=fn.when(b < 0, "debt").when(b < 5000, "some").otherwise("rich"), s=fn.case(col("c_mktsegment"), [("BUILDING", 1), ("MACHINERY", 2)], 0), i=fn.if_(col("c_nationkey") > 10, "hi", "lo"))


@query("select p_partkey as id, list_contains(string_split(p_name, ' '), 'a') as a, len(string_split(p_name, ' ')) as n, string_split(p_name, ' ')[1] as f, string_split(p_name, ' ')[100] as none, p_size in (1, 2, 3) as i from part")
def fn_array(g):
    w = col("p_name").split(" ")
    return g.nodes("Part").select(id=col("id"), a=w.contains_element("a"), n=w.size(), f=w.get(0), none=w.get(99), i=col("p_size").contains_element([1, 2, 3]))


@query("select cast(r_regionkey as bigint) as id, r_name as name, cast(r_regionkey as varchar) as k, cast(2 as bigint) as n, 'Region' as label from region")
def fn_map(g):
    p = fn.properties(col("Region"))
    return g.nodes("Region").select(id=fn.id_(col("Region")), name=p.get("r_name"), k=p.get("r_regionkey"), n=p.keys().size(), label=fn.labels(col("Region")).get(0))


_VEC = "list_transform(embedding, lambda x: x::double)"
_Q = f"(select {_VEC} from embeddings where vec_id = 0)"


@query(f"select vec_id as id, round(list_cosine_similarity({_VEC}, {_Q}), 6) as s from embeddings")
def fn_vector_cosine(g):
    q = g.nodes("Vector").filter(col("id") == 0).select(q=col("embedding"))
    return g.nodes("Vector").cross(q).select(id=col("Vector.id"), s=fn.round_(fn.sim(col("embedding"), col("q")), 6))


@query(f"select vec_id as id, round(list_distance({_VEC}, {_Q}), 6) as d, round(list_inner_product({_VEC}, {_Q}), 6) as p, round(sqrt(list_inner_product({_VEC}, {_VEC})), 6) as n, len(embedding) as k from embeddings")
def fn_vector_l2(g):
    q = g.nodes("Vector").filter(col("id") == 0).select(q=col("embedding"))
    e = col("embedding")
    return g.nodes("Vector").cross(q).select(id=col("Vector.id"), d=fn.round_(fn.distance(e, col("q")), 6), p=fn.round_(fn.inner_product(e, col("q")), 6), n=fn.round_(fn.l2_norm(e), 6), k=fn.vector_dim(e))


@query("select event_id as id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def fn_json(g):
    return Hypergraph(g.spark).with_nodes("Event", _events(g), "event_id").nodes("Event").select(id=col("id"), k=fn.get_json(col("props"), "$.k").cast("int"))


def _events(g: Hypergraph) -> DataFrame:
    path = g.tables_of("Region")[0].data.inputFiles()[0].rsplit("/", 1)[0]
    return read(g.spark, path, "events")


# --- schema and views


@query("""select 'NullNotAllowed' as kind, 'Customer' as label, 's' as property, c_custkey as id from customer where c_mktsegment = 'BUILDING'
    union all select 'MissingRequiredProperty', 'Customer', 'email', null union all select 'TypeMismatch', 'Customer', 'c_name', null""")
def schema_violations(g):
    t = g.tables_of("Customer")[0].data.withColumn("s", F.expr("nullif(c_mktsegment, 'BUILDING')"))
    declared = GraphSchema(nodes={"Customer": {"s": Property("string", nullable=False), "email": Property("string", required=True), "c_name": Property("int")}})
    return Hypergraph(g.spark).with_nodes("Customer", t).with_schema(declared).violations()


@query("select count(*) as n from orders join customer on o_custkey = c_custkey where c_acctbal > 0")
def subgraph_view(g):
    return g.subgraph({"Customer": "c_acctbal > 0"}).edges("PLACED").agg(n=count())


@query("select 'Customer' as l, count(*) as n from customer union all select 'Supplier', count(*) from supplier")
def adjacency(g):
    return g.adjacency("IN_NATION").groupBy(F.col("anchor_label").alias("l")).agg(F.count(F.lit(1)).alias("n"))


# --- windows of event time


@raw("select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def events_tumbling(spark, folder):
    return tumbling(read(spark, folder, "events")).withColumn("total", F.round("total", 4))


@raw("""with a as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as b from events),
    s as (select *, sum(b) over (partition by user_id order by ts rows unbounded preceding) as k from a)
    select user_id as "user", min(ts) as start, max(ts) + interval 30 minute as "end", count(*) as n from s group by user_id, k""")
def events_sessions(spark, folder):
    return sessions(read(spark, folder, "events"))
