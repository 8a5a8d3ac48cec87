"""Registered queries of the library itself, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import bind, call, hold
from quern.operators import bodies, entailment, fixpoint, graphs
from quern.operators.components import connected_components
from quern.session import new_path, table
from quern.sources import ntriples
from quern.sources.tables import relation, triples
from quern.streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "big_spenders"


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def money(column: str):
    """Exact sums of amounts, whatever the order of the rows."""
    return F.col(column).cast("decimal(18,2)")


@query("""select distinct c_custkey as c, o_orderkey as o from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
 join orders on o_custkey = c_custkey where r_name = 'ASIA' and o_totalprice > 200000""")
def big_spenders(spark, d):
    """Customers of a region with an order over a threshold: a body of four patterns and a comparison."""
    body = bodies.conjunction(
        hold(relation(spark, d, "orders", o="o_orderkey", c="o_custkey", t="o_totalprice"), "math:greaterThan", "t", 200000.0),
        relation(spark, d, "customer", c="c_custkey", n="c_nationkey"),
        relation(spark, d, "nation", n="n_nationkey", r="n_regionkey"),
        relation(spark, d, "region", r="r_regionkey", rn="r_name").filter("rn = 'ASIA'"),
    )
    return body.select("c", "o").distinct()


@query("select c_custkey as c, c_name as name from customer where c_acctbal > 9000 and c_mktsegment = 'BUILDING'")
def scan_filter(spark, d):
    return relation(spark, d, "customer", c="c_custkey", who="c_name", b="c_acctbal", seg="c_mktsegment").filter("b > 9000 and seg = 'BUILDING'").select("c", F.col("who").alias("name"))


@query("select distinct o_orderkey as o, s_suppkey as s from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey where c_nationkey = s_nationkey")
def local_supply(spark, d):
    """One variable in two patterns: orders with a supplier of the customer's own nation."""
    return bodies.conjunction(
        relation(spark, d, "lineitem", o="l_orderkey", s="l_suppkey"),
        relation(spark, d, "orders", o="o_orderkey", c="o_custkey"),
        relation(spark, d, "customer", c="c_custkey", n="c_nationkey"),
        relation(spark, d, "supplier", s="s_suppkey", n="s_nationkey"),
    ).select("o", "s").distinct()


@query("""select a.user_id as u, a.event_id as e1, b.event_id as e2 from events a join events b on a.user_id = b.user_id
 where a.event_type = 'error' and b.event_type = 'error' and epoch(b.ts)::bigint - epoch(a.ts)::bigint > 0 and epoch(b.ts)::bigint - epoch(a.ts)::bigint <= 7200""")
def error_pairs(spark, d):
    """Band self-join: errors of one user within two hours."""
    errors = relation(spark, d, "events", "ts", u="user_id", e="event_id", kind="event_type").filter("kind = 'error'")
    # seconds rounded, halves to even, as the SQL's cast does; the difference to the epoch depends on no time zone
    seconds = F.expr("cast(cast(ts - timestamp_ntz'1970-01-01 00:00:00' as interval second) as decimal(20, 6))").cast("double")
    errors = errors.select("u", "e", F.rint(seconds).cast("long").alias("t"))
    first, second = errors.select("u", F.col("e").alias("e1"), F.col("t").alias("t1")), errors.select("u", F.col("e").alias("e2"), F.col("t").alias("t2"))
    return bodies.band_join(first, second, ["u"], "t1", "t2", 7200).select("u", "e1", "e2")


@query("select o_orderkey as o from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)")
def orders_without_lines(spark, d):
    return bodies.negation(relation(spark, d, "orders", o="o_orderkey"), relation(spark, d, "lineitem", o="l_orderkey"))


@query("select c_custkey as c from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT')")
def customers_with_urgent_orders(spark, d):
    urgent = relation(spark, d, "orders", c="o_custkey", p="o_orderpriority").filter("p = '1-URGENT'")
    return bodies.includes(relation(spark, d, "customer", c="c_custkey"), urgent.select("c"))


@query("""select p_partkey as p, l.o from part left join (select l_partkey, min(l_orderkey) as o from lineitem where l_quantity >= 49 group by 1) l on l_partkey = p_partkey""")
def optional_large_line(spark, d):
    """An optional pattern's first solution: the earliest order of a large quantity, if any."""
    lines = relation(spark, d, "lineitem", p="l_partkey", o="l_orderkey", q="l_quantity").filter("q >= 49").select("p", "o")
    return bodies.optional_first(relation(spark, d, "part", p="p_partkey"), lines, [F.col("o")])


@query("""select c_custkey as c, count(o_orderkey) as n_orders, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as total, min(o_totalprice) as least, max(o_totalprice) as most
 from customer left join orders on o_custkey = c_custkey group by 1""")
def order_folds(spark, d):
    """Collected lists folded to count, sum, least and most without the lists."""
    orders = relation(spark, d, "orders", c="o_custkey", o="o_orderkey", t="o_totalprice")
    return bodies.fold_all(relation(spark, d, "customer", c="c_custkey"), orders, n_orders=F.count("o"), total=F.sum(money("t")).cast("double"), least=F.min("t"), most=F.max("t"))


@query("""select p_brand as brand, round(avg(p_size), 6) as mean, round(stddev_samp(p_size), 6) as deviation, round(sqrt(avg(p_size * p_size)), 6) as rms, round(corr(p_size, p_retailprice), 6) as correlation,
 round(covar_samp(p_size, p_retailprice), 4) as covariance from part group by 1""")
def brand_statistics(spark, d):
    part = relation(spark, d, "part", brand="p_brand", size="p_size", price="p_retailprice")
    return part.groupBy("brand").agg(
        F.round(F.avg("size"), 6).alias("mean"),
        F.round(F.stddev_samp("size"), 6).alias("deviation"),
        F.round(F.sqrt(F.avg(F.col("size") * F.col("size"))), 6).alias("rms"),
        F.round(F.corr("size", "price"), 6).alias("correlation"),
        F.round(F.covar_samp("size", "price"), 4).alias("covariance"),
    )


@query("select o_orderkey as o, count(l_orderkey) as n_lines from orders left join lineitem on l_orderkey = o_orderkey group by 1")
def line_counts(spark, d):
    """Counts with 0 for empty groups."""
    return bodies.fold_all(relation(spark, d, "orders", o="o_orderkey"), relation(spark, d, "lineitem", o="l_orderkey"), n_lines=F.count("*"))


@query("""select o_orderkey as o, coalesce(list_sort(list(l_partkey)), []) as parts from orders left join (select l_orderkey, l_partkey from lineitem where l_quantity > 45) on l_orderkey = o_orderkey group by 1
 having count(l_partkey) > 0 union all select o_orderkey, [] from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity > 45)""")
def collected_parts(spark, d):
    """All solutions as a list, empty where there is none."""
    lines = relation(spark, d, "lineitem", o="l_orderkey", p="l_partkey", q="l_quantity").filter("q > 45").select("o", "p")
    return bodies.collect_all(relation(spark, d, "orders", o="o_orderkey"), lines, "p", "parts")


@query("select o_orderkey as o from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_linestatus = 'O')")
def fulfilled_orders(spark, d):
    """Universal quantification: every line of the order is finished."""
    lines = relation(spark, d, "lineitem", o="l_orderkey", s="l_linestatus").select("o", "s").distinct()
    return bodies.for_all(relation(spark, d, "orders", o="o_orderkey"), lines, lines.filter("s != 'O'"))


@query("""select c_custkey as c, case when exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000) then 'large' else c_mktsegment end as label from customer""")
def conditional_label(spark, d):
    customers = relation(spark, d, "customer", c="c_custkey", seg="c_mktsegment")
    large = relation(spark, d, "orders", c="o_custkey", t="o_totalprice").filter("t > 300000").select("c")
    return bodies.if_then_else(customers, large, lambda x: x.select("c", F.lit("large").alias("label")), lambda x: x.select("c", F.col("seg").alias("label")))


NEXT_ORDER = "select o_orderkey as a, lead(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as b from orders where o_orderpriority = '1-URGENT'"


def _next_order(spark, d):
    urgent = relation(spark, d, "orders", c="o_custkey", o="o_orderkey", t="o_orderdate", p="o_orderpriority").filter("p = '1-URGENT'")
    following = F.lead("o").over(Window.partitionBy("c").orderBy("t", "o"))
    return urgent.select(F.col("o").alias("a"), following.alias("b")).filter("b is not null")


@query(f"with recursive e as (select a, b from ({NEXT_ORDER}) where b is not null), r as (select a, b from e union select r.a, e.b from r join e on r.b = e.a) select a, b from r")
def order_chain_closure(spark, d):
    """Transitive closure of an acyclic relation."""
    return fixpoint.transitive_closure(_next_order(spark, d))


TRADE = """select distinct s_nationkey as a, c_nationkey as b from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey
 where l_extendedprice > 60000 and l_discount = 0.0"""


def _trade(spark, d):
    lines = relation(spark, d, "lineitem", o="l_orderkey", s="l_suppkey", x="l_extendedprice", disc="l_discount").filter("x > 60000 and disc = 0.0").select("o", "s")
    return bodies.conjunction(lines, relation(spark, d, "orders", o="o_orderkey", c="o_custkey"), relation(spark, d, "customer", c="c_custkey", b="c_nationkey"), relation(spark, d, "supplier", s="s_suppkey", a="s_nationkey")).select("a", "b").distinct()


@query(f"with recursive e as ({TRADE}), r as (select a, b from e union select r.a, e.b from r join e on r.b = e.a) select a, b from r")
def trade_closure(spark, d):
    """Transitive closure of a cyclic relation."""
    return fixpoint.transitive_closure(_trade(spark, d))


@query(f"with recursive e as ({TRADE}), r as (select b as node from e where a = 3 union select e.b from r join e on r.node = e.a) select 3 as root, node from r")
def trade_reach(spark, d):
    """A goal with a bound subject: only what can be reached from it."""
    return fixpoint.reachable(_trade(spark, d), spark.createDataFrame([(3,)], "root int"))


@query(f"""with recursive e as ({TRADE}), r as (select 3 as node, 0 as hops union select e.b, r.hops + 1 from r join e on r.node = e.a where r.hops < 25)
 select 3 as root, node, min(hops)::int as hops from r group by node""")
def trade_distances(spark, d):
    return fixpoint.distances(_trade(spark, d), spark.createDataFrame([(3,)], "root int"))


@query("""select distinct s, o from (select 'part/' || p_partkey as s, unnest([p_type, split_part(p_type, ' ', -1), 'Part']) as o from part
 union all select 'orders/' || o_orderkey, unnest(['Order', 'Document']) from orders union all select 'customer/' || o_custkey, unnest(['Customer', 'Agent']) from orders)""")
def rdfs_types(spark, d):
    """RDFS: classes of parts, and domain and range of an order's customer."""
    part = relation(spark, d, "part", key="p_partkey", kind="p_type")
    facts = part.select(F.concat(F.lit("part/"), F.col("key")).alias("s"), F.lit("type").alias("p"), F.col("kind").alias("o"))
    last = F.substring_index("kind", " ", -1)
    schema = part.select(F.col("kind").alias("s"), last.alias("o")).unionByName(part.select(last.alias("s"), F.lit("Part").alias("o"))).distinct()
    schema = schema.filter("s != o").select("s", F.lit("subClassOf").alias("p"), "o")
    fixed = spark.createDataFrame([("o_custkey", "domain", "Order"), ("placedBy", "range", "Customer"), ("o_custkey", "subPropertyOf", "placedBy"), ("Order", "subClassOf", "Document"), ("Customer", "subClassOf", "Agent")], "s string, p string, o string")
    placed = relation(spark, d, "orders", o="o_orderkey", c="o_custkey").select(F.concat(F.lit("orders/"), F.col("o")).alias("s"), F.lit("o_custkey").alias("p"), F.concat(F.lit("customer/"), F.col("c")).alias("o"))
    every = entailment.rdfs(facts.unionByName(schema).unionByName(fixed).unionByName(placed))
    return every.filter("p = 'type'").select("s", "o").distinct()


@query("select distinct o_custkey as c, l_partkey as p from orders join lineitem on l_orderkey = o_orderkey where l_returnflag = 'R' and l_quantity > 30")
def owl_chain(spark, d):
    """OWL: an inverse property and a property chain give what customers buy."""
    placed_by = relation(spark, d, "orders", s="o_orderkey", o="o_custkey").select(F.concat(F.lit("o"), F.col("s")).alias("s"), F.lit("placedBy").alias("p"), F.col("o").cast("string").alias("o"))
    contains = relation(spark, d, "lineitem", s="l_orderkey", o="l_partkey", f="l_returnflag", q="l_quantity").filter("f = 'R' and q > 30")
    contains = contains.select(F.concat(F.lit("o"), F.col("s")).alias("s"), F.lit("contains").alias("p"), F.col("o").cast("string").alias("o"))
    schema = spark.createDataFrame([("placedBy", "inverseOf", "placed")], "s string, p string, o string")
    placed = entailment.inverse(placed_by.unionByName(schema))
    chains = spark.createDataFrame([("placed", "contains", "buys")], "first string, second string, result string")
    found = entailment.property_chain(placed.unionByName(contains), chains)
    return found.select(F.col("s").cast("long").alias("c"), F.col("o").cast("long").alias("p")).distinct()


@query(f"""with recursive e as ({TRADE}), b as (select a, b from e union select b, a from e), r as (select a, b from b union select r.a, b.b from r join b on r.b = b.a) select a, b from r""")
def owl_symmetric_transitive(spark, d):
    facts = _trade(spark, d).select(F.col("a").cast("string").alias("s"), F.lit("tradesWith").alias("p"), F.col("b").cast("string").alias("o"))
    schema = spark.createDataFrame([("tradesWith", "type", "SymmetricProperty"), ("tradesWith", "type", "TransitiveProperty")], "s string, p string, o string")
    every = entailment.entail(facts.unionByName(schema), (entailment.symmetric, entailment.transitive))
    return every.filter("p = 'tradesWith'").select(F.col("s").cast("int").alias("a"), F.col("o").cast("int").alias("b"))


@query("""with k as (select doc_id, min(doc_id) over (partition by lang, text) as label, count(*) over (partition by lang, text) as n from documents) select doc_id as id, label from k where n > 1""")
def owl_has_key(spark, d):
    """OWL hasKey: documents with the same language and text are the same."""
    docs = relation(spark, d, "documents", s="doc_id", lang="lang", text="text")
    facts = docs.select(F.format_string("%012d", "s").alias("s"), F.explode(F.array(F.struct(F.lit("type").alias("p"), F.lit("Document").alias("o")), F.struct(F.lit("lang").alias("p"), F.col("lang").alias("o")), F.struct(F.lit("digest").alias("p"), F.sha2(F.col("text").cast("binary"), 256).alias("o")))).alias("x")).select("s", "x.*")
    keys = spark.createDataFrame([("Document", "lang"), ("Document", "digest")], "class string, property string")
    classes = entailment.same_as(entailment.same_by_keys(facts, keys))
    return classes.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"))


@query("""with recursive k as (select p_partkey as n, p_brand || p_size as k1, p_type || p_size || p_name as k2 from part), e as (select min(n) over (partition by k1) as a, n as b from k union select min(n) over (partition by k2), n from k),
 g as (select a, b from e where a <> b union select b, a from e where a <> b), r as (select a as id, a as label from g union select g.b, r.label from r join g on g.a = r.id) select id, min(label) as label from r group by id""")
def same_parts(spark, d):
    """``sameAs`` from two inverse functional properties, closed as components."""
    part = relation(spark, d, "part", n="p_partkey", brand="p_brand", size="p_size", kind="p_type", name="p_name")
    facts = part.select(F.format_string("%012d", "n").alias("s"), F.explode(F.array(F.struct(F.lit("k1").alias("p"), F.concat("brand", "size").alias("o")), F.struct(F.lit("k2").alias("p"), F.concat("kind", "size", "name").alias("o")))).alias("x")).select("s", "x.*")
    schema = spark.createDataFrame([("k1", "type", "InverseFunctionalProperty"), ("k2", "type", "InverseFunctionalProperty")], "s string, p string, o string")
    classes = entailment.same_as(entailment.same_by_function(facts.unionByName(schema)))
    return classes.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"))


@query("""select distinct 'part/' || p_partkey as s, unnest(list_filter([case when p_size > 40 then 'Big' end, case when p_retailprice > 1500 then 'Dear' end, case when p_size > 40 and p_retailprice > 1500 then 'Grand' end,
 case when p_size > 40 or p_retailprice > 1500 then 'Notable' end], lambda x: x is not null)) as o from part""")
def owl_classes(spark, d):
    """OWL intersectionOf and unionOf."""
    part = relation(spark, d, "part", k="p_partkey", size="p_size", price="p_retailprice").withColumn("s", F.concat(F.lit("part/"), F.col("k")))
    facts = part.filter("size > 40").select("s", F.lit("type").alias("p"), F.lit("Big").alias("o")).unionByName(part.filter("price > 1500").select("s", F.lit("type").alias("p"), F.lit("Dear").alias("o")))
    both = spark.createDataFrame([("Grand", "Big"), ("Grand", "Dear")], "class string, member string")
    either = spark.createDataFrame([("Notable", "Big"), ("Notable", "Dear")], "class string, member string")
    return facts.unionByName(entailment.intersection_of(facts, both)).unionByName(entailment.union_of(facts, either)).select("s", "o").distinct()


@query("""select distinct l_suppkey as s, 'UrgentSupplier' as o from lineitem join orders on l_orderkey = o_orderkey where o_orderpriority = '1-URGENT'""")
def owl_all_values(spark, d):
    """OWL allValuesFrom: whoever supplies an urgent order is an urgent supplier."""
    types = relation(spark, d, "orders", s="o_orderkey", k="o_orderpriority").filter("k = '1-URGENT'").select(F.concat(F.lit("o"), F.col("s")).alias("s"), F.lit("type").alias("p"), F.lit("UrgentOrder").alias("o"))
    supplied = relation(spark, d, "lineitem", s="l_orderkey", o="l_suppkey").select(F.concat(F.lit("o"), F.col("s")).alias("s"), F.lit("suppliedBy").alias("p"), F.col("o").cast("string").alias("o"))
    rule = spark.createDataFrame([("UrgentOrder", "suppliedBy", "UrgentSupplier")], "class string, property string, filler string")
    found = entailment.some_or_all_values(types.unionByName(supplied), rule)
    return found.select(F.col("s").cast("long").alias("s"), "o").distinct()


def _order_graphs(spark, d):
    facts = triples(spark, d, "orders", ["o_orderstatus", "o_orderpriority", "o_custkey"])
    marks = facts.filter("p = 'o_orderpriority'").select("s", F.col("o").alias("level"))
    return facts.join(marks, "s").withColumn("g", F.when(F.col("level") < "3", "early")).drop("level")


@query("""select op, 3 * count(*) as n from (select unnest(list_filter([case when o_orderpriority < '3' or o_orderstatus = 'F' then 'union' end, case when o_orderpriority < '3' and o_orderstatus = 'F' then 'intersection' end,
 case when o_orderpriority < '3' and o_orderstatus <> 'F' then 'difference' end], lambda x: x is not null)) as op from orders) group by 1""")
def graph_sets(spark, d):
    """Union, intersection and difference of two named graphs that share facts."""
    facts = _order_graphs(spark, d)
    done = facts.filter("p = 'o_orderstatus' and o = 'F'").select("s")
    a, b = graphs.graph(facts, "early"), facts.join(done, "s", "left_semi").select("s", "p", "o")
    parts = [("union", graphs.union(a, b)), ("intersection", graphs.intersection(a, b)), ("difference", graphs.difference(a, b))]
    out = None
    for name, df in parts:
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query("select case when o_orderpriority < '3' then 'early' end as g, 3 * count(*) as n_triples from orders group by 1")
def graph_sizes(spark, d):
    return graphs.sizes(_order_graphs(spark, d))


@query("select 'orders/' || o_orderkey as s, 'o_orderstatus' as p, case when o_orderstatus = 'P' then 'F' else o_orderstatus end as o from orders")
def state_change(spark, d):
    """Retract and assert: pending orders become finished."""
    facts = triples(spark, d, "orders", ["o_orderstatus"])
    old = facts.filter("o = 'P'")
    return graphs.becomes(facts, old, old.withColumn("o", F.lit("F")))


@query("""select c_custkey as c, round(abs(c_acctbal), 6) as size, round(floor(c_acctbal), 6)::bigint as low, ceil(c_acctbal)::bigint as high, round(case when c_acctbal > 0 then ln(c_acctbal) end, 9) as logarithm, (((c_custkey % 7) - 3) % 5 + 5) % 5 as remainder,
 floor((c_custkey % 7 - 3) / 2.0)::bigint as quotient, round(sin(c_custkey), 9) as sine, round(1 / (1 + exp(-c_acctbal / 1000)), 9) as sigmoid, round(sqrt((power(c_acctbal, 2) + power(c_nationkey, 2)) / 2), 6) as rms from customer where c_acctbal > 0""")
def math_builtins(spark, d):
    rows = relation(spark, d, "customer", c="c_custkey", b="c_acctbal", n="c_nationkey")
    rows = bind(rows, "logarithm", "math:logarithm", "b")
    small = F.col("c") % 7 - 3
    return rows.select(
        "c",
        F.round(call("math:absoluteValue", "b"), 6).alias("size"),
        call("math:floor", "b").cast("long").alias("low"),
        call("math:ceiling", "b").cast("long").alias("high"),
        F.round("logarithm", 9).alias("logarithm"),
        call("math:remainder", small, 5).alias("remainder"),
        call("math:integerQuotient", small, 2).alias("quotient"),
        F.round(call("math:sin", "c"), 9).alias("sine"),
        F.round(call("e:sigmoid", F.col("b") / 1000), 9).alias("sigmoid"),
        F.round(call("math:rms", "b", "n"), 6).alias("rms"),
    )


@query("""select c_custkey as c, upper(c_name) as up, lower(c_mktsegment) as low, length(c_name) as size, reverse(c_name) as back, contains(c_name, '1') as has_one, regexp_replace(c_name, '[0-9]', '#', 'g') as masked, regexp_extract(c_name, '[0-9]+') as digits,
 substr(c_name, 3, 4) as mid, case when contains(c_name, '#') then split_part(c_name, '#', 1) else '' end as head, c_mktsegment || '/' || c_name as joined from customer where regexp_matches(c_name, '[02468]$')""")
def string_builtins(spark, d):
    rows = hold(relation(spark, d, "customer", c="c_custkey", name="c_name", seg="c_mktsegment"), "string:matches", "name", F.lit("[02468]$"))
    text = F.lit
    return rows.select(
        "c",
        call("string:upperCase", "name").alias("up"),
        call("string:lowerCase", "seg").alias("low"),
        call("string:length", "name").cast("long").alias("size"),
        call("string:stringReverse", "name").alias("back"),
        call("string:contains", "name", text("1")).alias("has_one"),
        call("string:replaceAll", "name", text("[0-9]"), text("#")).alias("masked"),
        call("string:scrape", "name", text("[0-9]+")).alias("digits"),
        call("string:substring", "name", 2, 4).alias("mid"),
        call("func:substring-before", "name", text("#")).alias("head"),
        call("string:concatenation", "seg", text("/"), "name").alias("joined"),
    )


@query("""with l as (select l_orderkey as o, list(l_partkey order by l_partkey) as x from lineitem group by 1) select o, len(x) as n, x[1] as first, x[len(x)] as last, list_reverse(x) as back, list_sort(list_distinct(x)) as kinds, x[2:] as rest from l""")
def list_builtins(spark, d):
    lists = relation(spark, d, "lineitem", o="l_orderkey", p="l_partkey").groupBy("o").agg(F.sort_array(F.collect_list("p")).alias("x"))
    return lists.select("o", call("list:length", "x").cast("long").alias("n"), call("list:first", "x").alias("first"), call("list:last", "x").alias("last"), call("list:reverse", "x").alias("back"), call("list:sort", call("list:unique", "x")).alias("kinds"), call("list:rest", "x").alias("rest"))


@query("""select l_orderkey as o, l_partkey as p, count(*) as n from (select l_orderkey, l_partkey from lineitem where l_quantity > 48) group by 1, 2""")
def list_members(spark, d):
    """A generator: every member of a collected list is a solution."""
    lists = relation(spark, d, "lineitem", o="l_orderkey", p="l_partkey", q="l_quantity").filter("q > 48").groupBy("o").agg(F.collect_list("p").alias("x"))
    return lists.select("o", F.explode(call("list:member", "x")).alias("p")).groupBy("o", "p").agg(F.count("*").alias("n"))


@query("select o_orderkey as o, year(o_orderdate)::int as y, month(o_orderdate)::int as m, day(o_orderdate)::int as d, hour(o_orderdate)::int as h, minute(o_orderdate)::int as mi, second(o_orderdate)::int as s from orders where o_orderdate >= timestamp '1996-01-01'")
def time_builtins(spark, d):
    rows = relation(spark, d, "orders", o="o_orderkey", t="o_orderdate").filter("t >= timestamp_ntz '1996-01-01 00:00:00'")
    names = {"y": "year", "m": "month", "d": "day", "h": "hour", "mi": "minute", "s": "second"}
    return rows.select("o", *[call(f"time:{b}", "t").cast("int").alias(a) for a, b in names.items()])


@query("select c_custkey as c, md5(c_name) as md5, sha1(c_name) as sha, sha256(c_name) as sha256 from customer")
def crypto_builtins(spark, d):
    rows = relation(spark, d, "customer", c="c_custkey", name="c_name")
    return rows.select("c", *[call(f"crypto:{n}", "name").alias(n) for n in ("md5", "sha", "sha256")])


@query("""select c, o, t from (select o_custkey as c, o_orderkey as o, o_totalprice as t, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as n from orders) where n = 1""")
def largest_order(spark, d):
    """Commit to the first solution."""
    orders = relation(spark, d, "orders", c="o_custkey", o="o_orderkey", t="o_totalprice")
    return bodies.first_solution(orders, ["c"], [-F.col("t"), F.col("o")])


@query("""select e.event_id as e, (select max_by(v.event_id, (v.ts, v.event_id)) from events v where v.user_id = e.user_id and v.event_type = 'view' and v.ts <= e.ts) as last_view from events e where e.event_type = 'error'""")
def last_view_before_error(spark, d):
    """As-of join: the user's latest view at the time of an error."""
    events = relation(spark, d, "events", "ts", u="user_id", e="event_id", kind="event_type")
    views = events.filter("kind = 'view'").groupBy("u", "ts").agg(F.max("e").alias("last_view"))
    found = bodies.as_of(events.filter("kind = 'error'").select("u", "ts", "e"), views, ["u"], "ts", "last_view")
    return found.select("e", "last_view")


@query("""select strftime(time_bucket(interval '6 hours', ts), '%Y-%m-%d %H:%M:%S') as window_start, event_type, count(*) as n_events, cast(sum(cast(value as decimal(18,4))) as double) as total from events group by 1, 2""")
def event_windows(spark, d):
    """Tumbling windows; the same function serves a stream."""
    events = relation(spark, d, "events", "ts", "event_type", "value").withColumn("value", F.col("value").cast("decimal(18,4)"))
    made = incremental.windowed_counts(events, "ts", "event_type", "value", "6 hours")
    return made.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n_events", F.col("total").cast("double").alias("total"))


@query("select distinct o_custkey as c, o_orderkey as o from orders join customer on o_custkey = c_custkey where o_totalprice > 250000 and c_acctbal > 0")
def incremental_spenders(spark, d):
    """A rule kept up to date by a stream that reads the orders in four batches."""
    source = incremental.batches(spark, table(spark, d, "orders"), 4, "o_orderkey")
    rich = relation(spark, d, "customer", c="c_custkey", b="c_acctbal").filter("b > 0")

    def rule(new, _):
        return new.filter("o_totalprice > 250000").select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("o")).join(rich, "c").select("c", "o")

    out = new_path(spark, "spenders")
    stream = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", 1).parquet(source)
    incremental.derive(stream, rule, out, new_path(spark, "offsets"), ["c", "o"]).awaitTermination()
    return spark.read.parquet(f"{out}/found").select("c", "o")


@query("""select s, p, o from (select 'customer/' || c_custkey as s, unnest([('c_name', c_name), ('c_mktsegment', c_mktsegment)]) as x from customer union all select 'documents/' || doc_id, ('text', text) from documents), lateral (select x[1] as p, x[2] as o)""")
def ntriples_round_trip(spark, d):
    """Two tables, one of long texts, written as N-Triples and read back."""
    facts = triples(spark, d, "customer", ["c_name", "c_mktsegment"]).select("s", "p", "o")
    docs = relation(spark, d, "documents", k="doc_id", o="text").select(F.concat(F.lit("documents/"), F.col("k")).alias("s"), F.lit("text").alias("p"), "o")
    facts = facts.unionByName(docs)
    path = new_path(spark, "triples")
    ntriples.write(facts.select(ntriples.iri(F.col("s")).alias("s"), ntriples.iri(F.col("p")).alias("p"), ntriples.literal(F.col("o")).alias("o")), path)
    strip = lambda c: F.regexp_replace(c, "^<|>$", "")
    return ntriples.read(spark, path).select(strip("s").alias("s"), strip("p").alias("p"), ntriples.lexical(F.col("o")).alias("o"))


@query("""select 'big' as rule, 1::int as round, count(*) as n_facts from orders where o_totalprice > 200000 union all
 select 'spender', 2, count(distinct o_custkey) from orders where o_totalprice > 200000 union all select 'given', 0, count(*) * 2 from orders""")
def lineage_counts(spark, d):
    """Derivations keep their rule and round."""
    orders = relation(spark, d, "orders", o="o_orderkey", c="o_custkey", t="o_totalprice")
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c))
    facts = orders.select(name("o", "o").alias("s"), F.lit("by").alias("p"), name("c", "c").alias("o")).unionByName(orders.select(name("o", "o").alias("s"), F.lit("total").alias("p"), F.col("t").cast("string").alias("o")))

    def big(f):
        return f.filter("p = 'total'").filter(F.col("o").cast("double") > 200000).select("s", F.lit("type").alias("p"), F.lit("Big").alias("o"))

    def spender(f):
        return bodies.conjunction(bodies.scan(f, "type", "x", "k").filter("k = 'Big'"), bodies.scan(f, "by", "x", "c")).select(F.col("c").alias("s"), F.lit("type").alias("p"), F.lit("Spender").alias("o"))

    found = fixpoint.with_lineage({"big": big, "spender": spender}, facts)
    return found.groupBy("rule", "round").agg(F.count("*").alias("n_facts"))


@query("""with recursive e as (select user_id as a, (value * 100)::bigint % 1000 + 100000 as b from events where event_type = 'purchase'), g as (select a, b from e union select b, a from e),
 r as (select a as id, a as label from g union select g.b, r.label from r join g on g.a = r.id) select id, min(label) as label from r group by id""")
def user_components(spark, d):
    """Connected components of users and amounts."""
    events = relation(spark, d, "events", u="user_id", kind="event_type", v="value").filter("kind = 'purchase'")
    return connected_components(events.select(F.col("u").alias("a"), (F.round(F.col("v") * 100).cast("long") % 1000 + 100000).alias("b")))


@query("select '_:sk' || sha256('[\"' || o_custkey || '\",\"' || o_orderpriority || '\"]') as node, count(*) as n_orders, min(o_custkey) as c, min(o_orderpriority) as level from orders group by o_custkey, o_orderpriority")
def skolem_heads(spark, d):
    """An existential head: one new node for each customer and priority, the same in every run."""
    orders = relation(spark, d, "orders", c="o_custkey", level="o_orderpriority")
    return orders.withColumn("node", call("log:skolem", "c", "level")).groupBy("node").agg(F.count("*").alias("n_orders"), F.min("c").alias("c"), F.min("level").alias("level"))


@query("""select s, p, o from (select 'customer/' || c_custkey as s, 'market' as p, c_mktsegment as o from customer union all select 'customer/' || c_custkey, 'trade', c_mktsegment from customer
 union all select 'customer/' || c_custkey, 'type', 'Builder' from customer where c_mktsegment = 'BUILDING' union all select 'customer/' || c_custkey, 'needs', 'permit' from customer where c_mktsegment = 'BUILDING')""")
def owl_equivalent_and_value(spark, d):
    """OWL equivalentProperty and hasValue."""
    customers = relation(spark, d, "customer", c="c_custkey", o="c_mktsegment").select(F.concat(F.lit("customer/"), F.col("c")).alias("s"), F.lit("market").alias("p"), "o")
    schema = spark.createDataFrame([("market", "equivalentProperty", "trade")], "s string, p string, o string")
    facts = customers.unionByName(entailment.equivalent_property(customers.unionByName(schema)))
    types = customers.filter("o = 'BUILDING'").select("s", F.lit("type").alias("p"), F.lit("Builder").alias("o"))
    values = spark.createDataFrame([("Builder", "needs", "permit")], "class string, property string, value string")
    return facts.unionByName(types).unionByName(entailment.has_value(types, values)).distinct()


@query("""with recursive e as (select user_id as u, event_id as a, lead(event_id) over (partition by user_id order by ts, event_id) as b from events where event_type in ('error', 'purchase')),
 r as (select e.a as root, e.b as node, 1 as n from e join events v on v.event_id = e.a where v.event_type = 'error' and e.b is not null
 union all select r.root, e.b, r.n + 1 from r join e on e.a = r.node where e.b is not null and r.n < 3) select root, node from r""")
def error_followers(spark, d):
    """A goal for many roots: what follows each error, three steps far."""
    chosen = relation(spark, d, "events", "ts", u="user_id", e="event_id", kind="event_type").filter("kind in ('error', 'purchase')")
    edges = chosen.select(F.col("e").alias("a"), F.lead("e").over(Window.partitionBy("u").orderBy("ts", "e")).alias("b"), "kind").filter("b is not null")
    start = edges.filter("kind = 'error'").select(F.col("a").alias("root"))
    hop = edges.select(F.col("a").alias("node"), F.col("b").alias("next"))
    first = start.join(hop, start["root"] == hop["node"]).select("root", F.col("next").alias("node"))
    out = reached = first
    for _ in range(2):
        reached = reached.join(hop, "node").select("root", F.col("next").alias("node"))
        out = out.unionByName(reached)
    return out


@query("""select s, o from (select 'supplier/' || s_suppkey as s, 'nation/' || s_nationkey as o from supplier) where s not in (select 'supplier/' || l_suppkey from lineitem where l_returnflag = 'R' and l_quantity >= 49.5)""")
def retracted_suppliers(spark, d):
    """Retraction: suppliers of a returned large quantity lose their nation."""
    facts = triples(spark, d, "supplier", ["s_nationkey"]).withColumn("o", F.concat(F.lit("nation/"), F.col("o")))
    bad = relation(spark, d, "lineitem", s="l_suppkey", f="l_returnflag", q="l_quantity").filter("f = 'R' and q >= 49.5").select(F.concat(F.lit("supplier/"), F.col("s")).alias("s")).distinct()
    return graphs.retract(facts, bodies.includes(facts, bad)).select("s", "o")


@query("""select o_orderkey as o, (2024 - year(o_orderdate) - case when month(o_orderdate) > 6 or (month(o_orderdate) = 6 and day(o_orderdate) > 29) then 1 else 0 end)::int as years from orders""")
def completed_years(spark, d):
    """Date difference in whole years."""
    orders = relation(spark, d, "orders", o="o_orderkey", t="o_orderdate")
    return bind(orders, "years", "time:completedYears", F.lit("2024-06-29").cast("timestamp"), "t").select("o", "years")


@query("""with l as (select l_orderkey as o, list(distinct l_suppkey) as x from lineitem group by 1), m as (select o, x, unnest(x) as item from l) select o, item, list_sort(list_filter(x, lambda y: y <> item)) as others from m""")
def list_selections(spark, d):
    """A generator of an item and the list without it."""
    lists = relation(spark, d, "lineitem", o="l_orderkey", s="l_suppkey").groupBy("o").agg(F.array_sort(F.collect_set("s")).alias("x"))
    return lists.select("o", F.explode(call("list:select", "x")).alias("e")).select("o", "e.item", F.col("e.rest").alias("others"))


@query("""select c_custkey as c, c_acctbal = c_nationkey as eq, c_acctbal <> c_nationkey as ne, c_acctbal < c_nationkey as lt, c_acctbal > c_nationkey as gt, c_acctbal >= c_nationkey as ge, c_acctbal <= c_nationkey as le, c_custkey + c_nationkey as total, c_custkey * c_nationkey as product,
 c_custkey - c_nationkey as difference, case when c_nationkey <> 0 then c_custkey / c_nationkey::double end as quotient, round(power(c_nationkey, 1.5), 6) as power, -c_acctbal as negative, round_even(c_acctbal, 0) as rounded, round_even(c_acctbal, 1) as tenth,
 round(cos(c_custkey), 9) as cosine, round(tan(c_custkey), 6) as tangent, round(sinh(c_nationkey / 10.0), 9) as sinh, round(cosh(c_nationkey / 10.0), 9) as cosh, round(tanh(c_nationkey / 10.0), 9) as tanh, round(atan(c_acctbal), 9) as atan, round(asinh(c_acctbal), 6) as asinh,
 round(degrees(c_custkey), 6) as degrees, round(radians(c_custkey), 9) as radians, case when c_nationkey <= 10 then round(asin(c_nationkey / 10.0), 9) end as asin, case when c_nationkey <= 10 then round(acos(c_nationkey / 10.0), 9) end as acos,
 case when c_nationkey >= 1 then round(acosh(c_nationkey), 9) end as acosh, case when c_nationkey < 10 then round(atanh(c_nationkey / 10.0), 9) end as atanh, round(atan2(c_acctbal, c_custkey), 9) as atan2, greatest(c_custkey, c_nationkey) as most, least(c_custkey, c_nationkey) as least_of,
 round((c_acctbal + c_nationkey) / 2, 6) as mean, round(abs(c_acctbal - c_nationkey) / sqrt(2), 6) as deviation, case when c_nationkey between 1 and 24 then round(-(c_nationkey / 25.0 * log2(c_nationkey / 25.0) + (1 - c_nationkey / 25.0) * log2(1 - c_nationkey / 25.0)), 9) else 0.0 end as entropy from customer""")
def math_functions(spark, d):
    """The other ``math:`` builtins and the numeric ones of ``e:``."""
    rows = relation(spark, d, "customer", c="c_custkey", b="c_acctbal", n="c_nationkey")
    tenth, r = F.col("n") / 10.0, F.round
    return rows.select(
        "c",
        *[call(f"math:{f}", "b", "n").alias(a) for a, f in {"eq": "equalTo", "ne": "notEqualTo", "lt": "lessThan", "gt": "greaterThan", "ge": "notLessThan", "le": "notGreaterThan"}.items()],
        *[call(f"math:{f}", "c", "n").alias(a) for a, f in {"total": "sum", "product": "product", "difference": "difference", "quotient": "quotient", "most": "max", "least_of": "min"}.items()],
        r(call("math:exponentiation", "n", 1.5), 6).alias("power"),
        call("math:negation", "b").alias("negative"),
        call("math:rounded", "b").alias("rounded"),
        call("math:roundedTo", "b", 1).alias("tenth"),
        r(call("math:cos", "c"), 9).alias("cosine"),
        r(call("math:tan", "c"), 6).alias("tangent"),
        *[r(call(f"math:{f}", tenth), 9).alias(f) for f in ("sinh", "cosh", "tanh", "asin", "acos", "atanh")],
        r(call("math:atan", "b"), 9).alias("atan"),
        r(call("math:asinh", "b"), 6).alias("asinh"),
        r(call("math:acosh", "n"), 9).alias("acosh"),
        r(call("math:degrees", "c"), 6).alias("degrees"),
        r(call("math:radians", "c"), 9).alias("radians"),
        r(call("math:atan2", "b", "c"), 9).alias("atan2"),
        r(call("math:avg", "b", "n"), 6).alias("mean"),
        r(call("math:std", "b", "n"), 6).alias("deviation"),
        r(call("e:binaryEntropy", F.col("n") / 25.0), 9).alias("entropy"),
    )


@query("""select p_partkey as p, starts_with(p_name, 'Part') as starts, suffix(p_type, 'STEEL') as ends, p_brand = p_type as same, p_brand < p_type as lt, p_brand > p_type as gt, p_brand >= p_type as ge, p_brand <= p_type as le, lower(p_type) = lower(p_name) as same_fold, lower(p_type) <> lower(p_name) as other_fold,
 contains(lower(p_type), 'steel') as has_fold, not regexp_matches(p_type, 'S') as lacks, regexp_replace(p_name, '[aeiou]', '*', 'g') as masked, upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) as capital, substr(p_name, 2, 1) as letter, substr(p_name, 1, 1) || '_' || substr(p_name, 3) as changed,
 array_to_string(regexp_extract_all(p_name, '[0-9]+'), ' ') as numbers, p_brand || '-' || p_type as joined, p_brand || ',' || p_size as csv, case when contains(p_type, ' ') then split_part(p_type, ' ', 1) else '' end as head, case when contains(p_type, ' ') then substr(p_type, strpos(p_type, ' ') + 1) else '' end as tail,
 translate(p_type, 'AEIOU', 'aeiou') as vowels, trim(regexp_replace(p_type, '\\s+', ' ', 'g')) as spaced, string_split(p_type, ' ') as words, substr(p_name, 3) as from_three, replace(p_type, ' ', '+') as encoded, sha1(p_name) as sha, regexp_extract('http://x.org/a#' || p_brand, '([^#/]*)$', 1) as name_of,
 regexp_extract('http://x.org/a#' || p_brand, '^(.*#)', 1) as space_of from part""")
def string_functions(spark, d):
    """The other ``string:``, ``func:``, ``pred:``, ``riff:`` builtins and those of ``log:`` and ``e:`` on text."""
    rows, text = relation(spark, d, "part", p="p_partkey", name="p_name", brand="p_brand", kind="p_type", size="p_size"), F.lit
    iri = F.concat(text("http://x.org/a#"), F.col("brand"))
    return rows.select(
        "p",
        call("func:starts-with", "name", text("Part")).alias("starts"),
        call("string:endsWith", "kind", text("STEEL")).alias("ends"),
        *[call(f"string:{f}", "brand", "kind").alias(a) for a, f in {"same": "equal", "lt": "lessThan", "gt": "greaterThan", "ge": "notLessThan", "le": "notGreaterThan"}.items()],
        call("string:equalIgnoringCase", "kind", "name").alias("same_fold"),
        call("string:notEqualIgnoringCase", "kind", "name").alias("other_fold"),
        call("string:containsIgnoringCase", "kind", text("Steel")).alias("has_fold"),
        call("string:notMatches", "kind", text("S")).alias("lacks"),
        call("string:replace", "name", text("[aeiou]"), text("*")).alias("masked"),
        call("string:capitalize", "kind").alias("capital"),
        call("string:charAt", "name", 1).alias("letter"),
        call("string:setCharAt", "name", 1, text("_")).alias("changed"),
        call("string:scrapeAll", "name", text("[0-9]+")).alias("numbers"),
        call("string:join", text("-"), "brand", "kind").alias("joined"),
        call("e:csvTuple", "brand", "size").alias("csv"),
        call("riff:substring-before", "kind", text(" ")).alias("head"),
        call("func:substring-after", "kind", text(" ")).alias("tail"),
        call("func:translate", "kind", text("AEIOU"), text("aeiou")).alias("vowels"),
        call("func:normalize-space", "kind").alias("spaced"),
        call("func:tokenize", "kind", text(" ")).alias("words"),
        call("func:substring", "name", 3).alias("from_three"),
        call("e:wwwFormEncode", "kind").alias("encoded"),
        call("crypto:sha", "name").alias("sha"),
        call("log:localName", iri).alias("name_of"),
        call("log:namespace", iri).alias("space_of"),
    )


@query("""with l as (select l_orderkey as o, list(l_partkey order by l_partkey) as x, list(l_suppkey order by l_suppkey) as y from lineitem group by 1) select o, x[2] as second, list_contains(x, 7) as has_seven, not list_contains(x, 7) as no_seven, list_concat(x, y) as both_lists,
 case when len(x) > 1 then list_concat(x[:1], x[3:]) end as without_second, list_filter(x, lambda i: list_contains(y, i)) as shared, list_sort(list_distinct(x)) = list_sort(list_distinct(y)) as same_set, list_sort(x) = list_sort(y) as same_bag, len(x) as n, x[1] as head, x[2:] as tail from l""")
def list_functions(spark, d):
    """The other ``list:``, ``rdf:`` and ``riff:`` builtins on collected lists."""
    lists = relation(spark, d, "lineitem", o="l_orderkey", p="l_partkey", s="l_suppkey").groupBy("o").agg(F.sort_array(F.collect_list("p")).alias("x"), F.sort_array(F.collect_list("s")).alias("y"))
    seven = F.lit(7).cast("long")
    return lists.select(
        "o",
        call("list:memberAt", "x", 1).alias("second"),
        call("list:in", seven, "x").alias("has_seven"),
        call("list:notMember", "x", seven).alias("no_seven"),
        call("riff:concatenate", "x", "y").alias("both_lists"),
        call("list:removeAt", "x", 1).alias("without_second"),
        call("list:intersection", "x", "y").alias("shared"),
        call("list:setEqualTo", "x", "y").alias("same_set"),
        call("list:multisetEqualTo", "x", "y").alias("same_bag"),
        call("math:memberCount", "x").cast("long").alias("n"),
        call("list:firstRest", "x")["first"].alias("head"),
        call("rdf:rest", "x").alias("tail"),
    )
