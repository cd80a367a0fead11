"""The query catalogue over the star-schema tables: each query a program, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hornspark.engine import Engine

#: relation name -> (table, columns by position)
BINDINGS = {
    "region": ("region", ["r_regionkey", "r_name"]),
    "nation": ("nation", ["n_nationkey", "n_name", "n_regionkey"]),
    "cust": ("customer", ["c_custkey", "c_nationkey", "c_mktsegment"]),
    "supp": ("supplier", ["s_suppkey", "s_nationkey"]),
    "ord": ("orders", ["o_orderkey", "o_custkey", "o_orderstatus"]),
    "li": ("lineitem", ["l_orderkey", "l_partkey", "l_suppkey"]),
    "flag": ("lineitem", ["l_orderkey", "l_returnflag", "l_linestatus"]),
    "part": ("part", ["p_partkey", "p_brand", "p_size"]),
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive turns of a conversation."""
    t = _table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    after = t.select("conv_id", F.col("turn").alias("after"))
    return t.withColumn("after", F.col("turn") + 1).join(after, ["conv_id", "after"], "left_semi").select("conv_id", "turn", "after")


def _trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier's nation to customer's nation, over large orders of one status only, so that the graph stays sparse."""
    li = _table(spark, sf_dir, "lineitem").filter("l_quantity >= 50 and l_discount >= 0.09")
    orders = _table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'")
    supp = _table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("a"))
    cust = _table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("b"))
    found = li.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(supp, F.col("l_suppkey") == F.col("s_suppkey")).join(cust, F.col("o_custkey") == F.col("c_custkey"))
    return found.select("a", "b").distinct()


def _edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations in a ring with chords that depend on the region: a small cyclic graph."""
    n = _table(spark, sf_dir, "nation")
    ring = n.filter("n_nationkey < 12").select(F.col("n_nationkey").alias("a"), ((F.col("n_nationkey") + 1) % 12).alias("b"))
    return ring.union(n.filter("n_nationkey >= 12").select("n_nationkey", "n_regionkey"))


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their pending orders, or with NULL."""
    orders = _table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select("o_custkey", "o_orderkey")
    cust = _table(spark, sf_dir, "customer").select("c_custkey")
    return cust.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring line numbers of an order."""
    li = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    after = li.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber")).distinct()
    return li.join(after, ["l_orderkey", "l_linenumber"], "left_semi").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") + 1).alias("after"))


DERIVED: dict[str, Callable[[SparkSession, str], DataFrame]] = {"next": _turns, "trade": _trade, "edge": _edge, "placed": _placed, "nextline": _lines}

NEXT = "nxt as (select distinct a.conv_id, a.turn, a.turn + 1 as after from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1)"
TRADE = "trade as (select distinct s_nationkey as a, c_nationkey as b from lineitem join orders on l_orderkey = o_orderkey join supplier on l_suppkey = s_suppkey join customer on o_custkey = c_custkey where l_quantity >= 50 and l_discount >= 0.09 and o_orderstatus = 'P')"
EDGE = "edge as (select n_nationkey as a, (n_nationkey + 1) % 12 as b from nation where n_nationkey < 12 union select n_nationkey, n_regionkey from nation where n_nationkey >= 12)"

#: name -> (facts and rules, query, output columns, SQL)
QUERIES: dict[str, tuple[str, str, str, list[str], str]] = {}


def _add(name: str, query: str, columns: str, sql: str, rules: str = "", facts: str = "") -> None:
    QUERIES[name] = (facts, rules, query, columns.split(), sql)


_add("scan_all", "region(K,N)", "k n", "select distinct r_regionkey as k, r_name as n from region")
_add("select_const", "nation(K,N,'1')", "k n", "select distinct n_nationkey as k, n_name as n from nation where n_regionkey = 1")
_add("select_multi_const", "cust(K,'3','BUILDING')", "k", "select distinct c_custkey as k from customer where c_nationkey = 3 and c_mktsegment = 'BUILDING'")
_add("prefix_arity", "li(O,P)", "o p", "select distinct l_orderkey as o, l_partkey as p from lineitem")
_add("long_atom_empty", "region(K,N,X)", "k n x", "select r_regionkey as k, r_name as n, '' as x from region where false")
_add("project_distinct", "flags(F,S)", "f s", "select distinct l_returnflag as f, l_linestatus as s from lineitem", "flags(F,S) :- flag(O,F,S).")
_add("wildcard_expr", "nation(K,(a+b),R)", "k r", "select distinct n_nationkey as k, n_regionkey as r from nation")
_add("repeat_var", "edge(X,X)", "x", f"with {EDGE} select distinct a as x from edge where a = b")
_add("repeat_var_join", "home(X,X)", "x", "select distinct s_nationkey as x from lineitem join orders on l_orderkey = o_orderkey join supplier on l_suppkey = s_suppkey join customer on o_custkey = c_custkey where s_nationkey = c_nationkey", "home(N,M) :- li(O,P,S),ord(O,C,T),supp(S,N),cust(C,M,G).")
_add("repeat_var_partial", "nation(R,N,R)", "r n", "select distinct n_regionkey as r, n_name as n from nation where n_nationkey = n_regionkey")
_add("ground_yes", "region('1',(a+b))", "matched", "select distinct true as matched from region where r_regionkey = 1")
_add("ground_no", "region('77',(a*b))", "matched", "select distinct true as matched from region where r_regionkey = 77")
_add("text_constant_typed", "cust('007',N,S)", "n s", "select c_nationkey as n, c_mktsegment as s from customer where cast(c_custkey as varchar) = '007'")
_add("join2", "located(N,R)", "n r", "select distinct n_name as n, r_name as r from nation join region on n_regionkey = r_regionkey", "located(N,R) :- nation(K,N,G),region(G,R).")
_add("join3", "cr(C,R)", "c r", "select distinct c_custkey as c, r_name as r from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey", "cr(C,R) :- cust(C,K,S),nation(K,N,G),region(G,R).")
_add("join5", "sold(P,R)", "p r", "select distinct l_partkey as p, r_name as r from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey", "sold(P,R) :- li(O,P,S),ord(O,C,T),cust(C,K,M),nation(K,N,G),region(G,R).")
_add("join_multi_key", "local(O,S)", "o s", "select distinct l_orderkey as o, l_suppkey as s from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey and c_nationkey = s_nationkey", "local(O,S) :- li(O,P,S),ord(O,C,T),cust(C,N,M),supp(S,N).")
_add("self_join", "together(S,T)", "s t", "select distinct a.l_suppkey as s, b.l_suppkey as t from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey join supplier sa on a.l_suppkey = sa.s_suppkey join supplier sb on b.l_suppkey = sb.s_suppkey where sa.s_nationkey = 3 and sb.s_nationkey = 4", "together(S,T) :- li(O,P,S),li(O,Q,T),supp(S,'3'),supp(T,'4').")
_add("self_join_all", "together(S,T)", "s t", "select distinct a.l_suppkey as s, b.l_suppkey as t from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey", "together(S,T) :- li(O,P,S),li(O,Q,T).")
_add("semi_join_shape", "busy(S)", "s", "select distinct l_suppkey as s from lineitem join orders on l_orderkey = o_orderkey where o_orderstatus = 'P'", "busy(S) :- li(O,P,S),ord(O,C,'P').")
_add("cross_product", "pair(X,Y)", "x y", "select a.r_regionkey as x, b.r_regionkey as y from region a cross join region b", "pair(X,Y) :- region(X,A),region(Y,B).")
_add("ground_guard", "guarded(N)", "n", "select distinct n_name as n from nation where exists (select 1 from region where r_regionkey = 2)", "guarded(N) :- region('2',(a+b)),nation(K,N,R).")
_add("ground_guard_false", "guarded(N)", "n", "select distinct n_name as n from nation where exists (select 1 from region where r_regionkey = 99)", "guarded(N) :- nation(K,N,R),region('99',(a+b)).")
_add("empty_atom_join", "none(N)", "n", "select n_name as n from nation where false", "none(N) :- nation(K,N,R),ghost(K).")
_add("intersect_rule", "both(N)", "n", "select c_nationkey as n from customer where c_mktsegment = 'BUILDING' intersect select s_nationkey from supplier", "both(N) :- cust(C,N,'BUILDING'),supp(S,N).")
_add("union_rules", "any(N)", "n", "select c_nationkey as n from customer where c_mktsegment = 'MACHINERY' union select s_nationkey from supplier", "any(N) :- cust(C,N,'MACHINERY'). any(N) :- supp(S,N).")
_add("union_mixed_types", "mix(X)", "x", "select cast(n_nationkey as varchar) as x from nation union select r_name from region", "mix(X) :- nation(X,N,R). mix(X) :- region(K,X).")
_add("head_permute", "flip(N,K)", "n k", "select distinct n_name as n, n_nationkey as k from nation", "flip(N,K) :- nation(K,N,R).")
_add("head_repeat", "twice(X,Y)", "x y", "select distinct r_regionkey as x, r_regionkey as y from region", "twice(K,K) :- region(K,N).")
_add("unsafe_rule_skipped", "u(X)", "x", "select distinct r_regionkey as x from region", "u(K) :- region(K,N). u(Z) :- nation(K,N,R).")
_add("inline_facts", "vip(N,L)", "n l", "select n_name as n, case n_nationkey when 3 then 'gold' else 'it''s' end as l from nation where n_nationkey in (3, 5)", "vip(N,L) :- tag(K,L),nation(K,N,R).", "tag('3','gold'). tag('5','it''s'). tag('3','gold'). tag('x','none').")
_add("edb_plus_idb", "supp(S,N)", "s n", "select s_suppkey as s, s_nationkey as n from supplier union select c_custkey, c_nationkey from customer where c_mktsegment = 'BUILDING'", "supp(C,N) :- cust(C,N,'BUILDING').")
_add("tc_linear", "reach(C,A,B)", "c a b", f"with recursive {NEXT}, reach as (select conv_id, turn, after from nxt union select r.conv_id, r.turn, n.after from reach r join nxt n on r.conv_id = n.conv_id and r.after = n.turn) select conv_id as c, turn as a, after as b from reach", "reach(C,A,B) :- next(C,A,B). reach(C,A,D) :- reach(C,A,B),next(C,B,D).")
_add("tc_nonlinear", "reach(C,A,B)", "c a b", f"with recursive {NEXT}, reach as (select conv_id, turn, after from nxt union select r.conv_id, r.turn, n.after from reach r join nxt n on r.conv_id = n.conv_id and r.after = n.turn) select conv_id as c, turn as a, after as b from reach", "reach(C,A,B) :- next(C,A,B). reach(C,A,D) :- reach(C,A,B),reach(C,B,D).")
_add("tc_cyclic", "path(A,B)", "a b", f"with recursive {TRADE}, path as (select a, b from trade union select p.a, t.b from path p join trade t on p.b = t.a) select a, b from path", "path(A,B) :- trade(A,B). path(A,C) :- path(A,B),trade(B,C).")
_add("tc_from_constant", "path('0',B)", "b", f"with recursive {EDGE}, path as (select a, b from edge union select p.a, t.b from path p join edge t on p.b = t.a) select b from path where a = 0", "path(A,B) :- edge(A,B). path(A,C) :- path(A,B),edge(B,C).")
_add("symmetric_closure", "sym(A,B)", "a b", f"with {EDGE} select a, b from edge union select b, a from edge", "sym(A,B) :- edge(A,B). sym(A,B) :- sym(B,A).")
_add("same_generation", "sg(A,B)", "a b", f"with recursive {EDGE}, sg as (select x.a, y.a as b from edge x join edge y on x.b = y.b union select x.a, y.a from sg join edge x on x.b = sg.a join edge y on y.b = sg.b) select a, b from sg", "sg(A,B) :- edge(A,P),edge(B,P). sg(A,B) :- edge(A,P),sg(P,Q),edge(B,Q).")
_add("mutual_recursion", "even(A,B)", "a b", f"with recursive {EDGE}, walk as (select a, b, 1 as odd from edge union select w.a, e.b, 1 - w.odd from walk w join edge e on w.b = e.a) select distinct a, b from walk where odd = 0", "odd(A,B) :- edge(A,B). odd(A,C) :- even(A,B),edge(B,C). even(A,C) :- odd(A,B),edge(B,C).")
_add("strata_chain", "top(N)", "n", "select distinct n_name as n from nation join region on n_regionkey = r_regionkey where r_regionkey = 2", "top(N) :- mid(N). mid(N) :- low(N). low(N) :- nation(K,N,'2'). side(N) :- top(N).")
_add("fact_domain", "dom(X)", "x", "select n_nationkey as x from nation union select n_regionkey from nation", "dom(X) :- nation(X,N,R). dom(X) :- nation(K,N,X).")


_add("null_dropped", "placed(C,O)", "c o", "select distinct c_custkey as c, o_orderkey as o from customer join orders on c_custkey = o_custkey where o_orderstatus = 'P'")
_add("null_unbound", "placed(C)", "c", "select distinct c_custkey as c from customer")
_add("null_in_rule", "open(C,S)", "c s", "select distinct c_custkey as c, l_suppkey as s from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey where o_orderstatus = 'P'", "open(C,S) :- placed(C,O),li(O,P,S).")
_add("repeat_var_rows", "li(O,X,X)", "o x", "select distinct l_orderkey as o, l_partkey as x from lineitem where l_partkey = l_suppkey")
LINE = "ln as (select distinct a.l_orderkey as o, a.l_linenumber as a, a.l_linenumber + 1 as b from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and b.l_linenumber = a.l_linenumber + 1)"
_add("tc_lines", "later(O,A,B)", "o a b", f"with recursive {LINE}, later as (select o, a, b from ln union select r.o, r.a, n.b from later r join ln n on r.o = n.o and r.b = n.a) select o, a, b from later", "later(O,A,B) :- nextline(O,A,B). later(O,A,C) :- later(O,A,B),nextline(O,B,C).")


def program_text(name: str) -> str:
    facts, rules, query, _, _ = QUERIES[name]
    schemes = " ".join({f"{f.strip().split('(')[0]}(a)" for f in facts.split(".") if f.strip()}) or "none(a)"
    return f"Schemes: {schemes} Facts: {facts} Rules: {rules} Queries: {query}?"


def run_query(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = program_text(name)
    engine = Engine(spark)
    for relation, (table, columns) in BINDINGS.items():
        if f"{relation}(" in text:
            engine.register(relation, _table(spark, sf_dir, table), columns)
    for relation, build in DERIVED.items():
        if f"{relation}(" in text:
            engine.register(relation, build(spark, sf_dir))
    return engine.query(text).toDF(*QUERIES[name][3])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, name=name: run_query(spark, sf_dir, name)) for name in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {name: q[-1] for name, q in QUERIES.items()}
