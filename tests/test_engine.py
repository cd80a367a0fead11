"""Whole programs: relational, interpreter and optimizer answers, pass counts, reports, random programs."""

import random
import warnings

import pytest
from pyspark.sql import functions as F

from hornspark import report
from hornspark.cli import main
from hornspark.engine import Engine, UnsafeRuleWarning
from hornspark.operators import fixpoint
from hornspark.plans.nodes import Scheme
from hornspark.plans.parser import parse
from hornspark.session import Session


def answers(spark, text, **options):
    out = []
    for q in Engine(spark).run(text, **options).queries:
        rows = {tuple(r) for r in q.df.collect()}
        out.append(len(rows))
    return out


def program(schemes, facts, rules, queries):
    return f"Schemes: {schemes} Facts: {facts} Rules: {rules} Queries: {queries}"


LINES = """
  line('bus','north','hub','hub','5'). line('bus','hub','hub','south','5'). line('tram','north','north','hub','7').
  line('tram','south','hub','south','7'). line('bus','hub','north','hub','9'). line('ferry','pier','pier','pier','9').
"""


@pytest.mark.parametrize(
    ("query", "count"),
    [
        ("line('bus',F,V,T,C)", 3),  # a constant
        ("line('bus',F,V,'hub',C)", 2),  # two
        ("line(K,F,V,T,C)", 6),
        ("line(K)", 3),  # a prefix, as a set
        ("line('tram',F)", 2),
        ("line(K,S,S,T,C)", 3),  # a repeated variable
        ("line(K,S,S,S,C)", 1),
        ("line(K,S,V,S,C)", 3),
        ("line(K,A,B,B,C)", 2),
        ("line(K,A,A,B,B)", 0),
        ("line('bus',S,S,T,'5')", 1),  # both
        ("line(K,(a+b),V,T,C)", 6),  # an expression matches anything
        ("line((a*b),'north')", 1),  # and brings no column
        ("line('ferry','pier')", 1),  # no variable: yes
        ("line('ferry','hub')", 0),
        ("line(K,F,V,T,C,X)", 0),  # longer than the relation
        ("line('bus','north','hub','hub','5','x')", 0),
        ("plane(X)", 0),  # unknown
        ("plane('x')", 0),
    ],
)
def test_atoms(spark, query, count):
    assert answers(spark, program("line(kind,from,via,to,cost)", LINES, "", f"{query}?")) == [count]


def test_repeated_variable_without_match_keeps_no_other_column(spark):
    assert answers(spark, program("t(a,b,c)", "t('1','2','9').", "", "t(X,X,Y)? t(X,Y,Z)?")) == [0, 1]


def test_repeated_facts_and_those_of_no_scheme(spark):
    facts = "likes('ann','tea'). likes('bob','tea'). likes('ann','tea'). likes('tea','tea'). hates('ann','milk')."
    assert answers(spark, program("likes(who,what)", facts, "", "likes(W,X)? likes(W,'tea')? likes(X,X)? hates(W,X)? likes('bob','tea')?"), evaluation="relational") == [3, 3, 1, 0, 1]


def test_ragged_facts(spark):
    assert answers(spark, program("r(a)", "r('1'). r('1','2').", "s(X,Y):-r(X,Y).", "r(X)? r(X,Y)? s(X,Y)?")) == [1, 1, 1]


# A family of four generations, oldest first; every rule set of its own kind of recursion.
FAMILY = program(
    "parent(old,young)",
    "parent('eva','ida'). parent('eva','jon'). parent('ida','kim'). parent('jon','leo'). parent('jon','mia'). parent('kim','noa'). parent('mia','ole').",
    """elder(A,B) :- parent(A,B).
       elder(A,C) :- elder(A,B),parent(B,C).
       kin(A,B) :- elder(A,B).
       kin(A,B) :- kin(B,A).
       peer(A,B) :- parent(P,A),parent(P,B).
       peer(A,B) :- parent(P,A),peer(P,Q),parent(Q,B).
       even(A,C) :- odd(A,B),parent(B,C).
       odd(A,B) :- parent(A,B).
       odd(A,C) :- even(A,B),parent(B,C).
       root(A) :- elder(A,B),elder(B,C),elder(C,D).""",
    "elder('jon',B)? elder(A,B)? kin('ole',B)? peer('noa',B)? even('eva',B)? odd(A,'ole')? root(A)? kin('leo','mia')?",
)


@pytest.mark.parametrize(("evaluation", "mode"), [("interpreter", "compat"), ("interpreter", "fast"), ("optimized", "compat"), ("optimized", "fast")])
def test_recursion(spark, evaluation, mode):
    result = Engine(spark).run(FAMILY, evaluation=evaluation, mode=mode)
    got = [{tuple(r) for r in q.df.collect()} for q in result.queries]
    assert got == brute(parse(FAMILY))[:-1] + [set()]
    assert [len(x) for x in got] == [3, 14, 3, 2, 3, 2, 1, 0]
    if evaluation == "optimized":
        assert sorted(map(tuple, (c for c, _ in result.components))) == [(0,), (1,), (2,), (3,), (4,), (5,), (6, 8), (7,), (9,)]
        order = [i for c, _ in result.components for i in c]
        assert all(order.index(j) < order.index(i) for i, j in ((1, 0), (2, 1), (3, 2), (5, 4), (6, 7), (9, 1)))


def test_passes_are_counted_to_the_first_without_change(spark):
    """Rules see what earlier ones of the same pass found: a chain in program order takes two passes, in reverse one for each link."""
    forth = " ".join(f"p{i + 1}(X) :- p{i}(X)." for i in range(4))
    back = " ".join(f"p{i + 1}(X) :- p{i}(X)." for i in reversed(range(4)))
    for rules, passes in ((forth, 2), (back, 5), ("", 1), ("p1(X) :- p9(X).", 1)):
        run = Engine(spark).run(program("p0(a)", "p0('v').", rules, "p4(X)?"), evaluation="interpreter", mode="compat")
        assert run.passes == passes and run.queries[0].df.count() == (1 if passes in (2, 5) else 0)


def test_every_tuple_over_a_domain(spark):
    """Rotation, exchange and copying of columns reach all 4 ** 4 tuples from one."""
    rules = "t(B,C,D,A):-t(A,B,C,D). t(B,A,C,D):-t(A,B,C,D). t(A,A,C,D):-t(A,B,C,D)."
    assert answers(spark, program("t(a,b,c,d)", "t('w','x','y','z').", rules, "t(A,B,C,D)? t(X,X,X,X)?")) == [256, 4]


def test_heads_add_to_facts_and_bodies_may_share_nothing(spark):
    text = program("size(n) colour(c) stock(n,c)", "size('s'). size('m'). colour('red'). stock('xl','blue').", "stock(N,C) :- size(N),colour(C). known(C) :- stock(N,C).", "stock(N,C)? known(C)?")
    assert answers(spark, text) == [3, 2]
    assert answers(spark, text, evaluation="interpreter", mode="compat") == [3, 2]


def test_empty_parts_of_a_body(spark):
    schemes, facts = "open(d) day(d) pair(a,b)", "day('mon'). pair('x','y')."
    assert answers(spark, program(schemes, facts, "visit(D) :- day(D),open(D). meet(B) :- day(B),pair(A,A).", "visit(D)? meet(B)?")) == [0, 0]
    assert answers(spark, program(schemes, facts, "on(D) :- pair('x','y'),day(D). off(D) :- day(D),pair('y','x').", "on(D)? off(D)?")) == [1, 0]


@pytest.mark.parametrize("rows", [1, 10**9])
def test_increments_of_any_size(spark, monkeypatch, rows):
    """Bucketed from the first row on, or never; merged often."""
    monkeypatch.setattr(fixpoint, "BUCKET_ROWS", rows)
    monkeypatch.setattr(fixpoint, "COMPACT_AFTER", 2)
    edges = [(i, (i * 7 + 3) % 23) for i in range(23)] + [(i, i + 1) for i in range(12)]
    reach = {a: {b for x, b in edges if x == a} for a in range(23)}
    for _ in range(23):
        for a in reach:
            reach[a] |= {c for b in set(reach[a]) for c in reach[b]}
    for rules in ("path(A,B) :- edge(A,B). path(A,C) :- path(A,B),edge(B,C).", "path(A,B) :- edge(A,B). path(A,C) :- path(A,B),path(B,C)."):
        for options in ({}, {"evaluation": "interpreter", "mode": "compat"}):
            df = Engine(spark).register("edge", spark.createDataFrame(edges, "a int, b int")).query(program("n(a)", "", rules, "path(A,B)?"), **options)
            assert sorted(map(tuple, df.collect())) == sorted((a, b) for a in reach for b in reach[a])


def test_a_large_relation_is_not_shuffled_again(spark, monkeypatch):
    monkeypatch.setattr(fixpoint, "BUCKET_ROWS", 1)
    store = fixpoint.Store(spark, {"p": spark.createDataFrame([], "c0 long, c1 long")})
    store.relations["p"].parts[0].rows = 0
    pairs = spark.range(2000).select(F.col("id").alias("c0"), (F.col("id") % 7).alias("c1"))
    assert store.grow("p", [pairs]) and store.grow("p", [pairs.withColumn("c1", F.col("c1") + 1)]) and store.grow("p", [pairs.withColumn("c1", F.col("c1") + 2)])
    assert [p.bucketed for p in store.relations["p"].parts[1:]] == [True, True, True]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = store.fresh("p", [pairs])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Bucketed: true") == 3  # what was derived alone moves
    assert store.relations["p"].frame.count() == 2000 + 2000 + 2000 and not store.grow("p", [pairs])


# --- constants of a query reach into recursion ---

CHAIN = [(i, i + 1) for i in range(8)] + [(i, i + 1) for i in range(20, 66)]


@pytest.mark.parametrize(
    ("rules", "most"),
    [
        ("path(A,B) :- edge(A,B). path(A,C) :- path(A,B),edge(B,C).", 6),
        ("path(A,B) :- edge(A,B). path(A,C) :- edge(A,B),path(B,C).", 21),
        ("path(A,B) :- edge(A,B). path(A,C) :- path(A,B),path(B,C).", 21),
    ],
)
def test_only_what_bears_on_the_answer_is_derived(spark, rules, most):
    engine = Engine(spark).register("edge", spark.createDataFrame(CHAIN, "a int, b int"))
    result = engine.ask(program("n(a)", "", rules, "path('60',B)?"))
    assert sorted(r.B for r in result.queries[0].df.collect()) == [61, 62, 63, 64, 65, 66]
    assert result.relations["path^bf"].count() == most  # the whole closure has 1117
    kind = Engine(spark).register("edge", spark.createDataFrame(CHAIN[:2], "a int, b int")).query(program("n(a)", "", rules, "path('0',B)?"), on_demand=False).schema
    assert result.queries[0].df.schema == kind
    assert engine.query(program("n(a)", "", rules, "path('x',B)?")).count() == engine.query(program("n(a)", "", rules, "path('060',B)?")).count() == 0
    assert engine.query(program("n(a)", "", rules, "path('60','65')?")).count() == 1


@pytest.mark.parametrize("seed", range(6))
def test_random_recursion_on_demand(spark, seed):
    rng = random.Random(100 + seed)
    edges = " ".join(f"{rng.choice('ef')}('{rng.randrange(5)}','{rng.randrange(5)}')." for _ in range(9))
    term = lambda: rng.choice(["X", "Y", "Z", "W", "X", "Y", "'1'"])
    rules = ["p(X,Y) :- e(X,Y).", "q(X,Y) :- f(X,Y)."]
    for _ in range(3):
        body = [f"{rng.choice('efpqpq')}({term()},{term()})" for _ in range(rng.randint(1, 3))]
        free = sorted({c for b in body for c in b if c in "XYZW"})
        if free:
            rules.append(f"{rng.choice('pq')}({rng.choice(free)},{rng.choice(free)}) :- {','.join(body)}.")
    for query in ("p('1',B)", "q(A,'2')", "p('1','3')"):
        text = program("e(a,b) f(a,b)", edges, " ".join(rules), f"{query}?")
        want = brute(parse(text))[-1]
        got = {tuple(r) for r in Engine(spark).query(text).collect()}
        assert got == want or "A" not in query and "B" not in query and bool(got) == bool(want), text


# --- step by step ---


def test_session_step_by_step(spark):
    text = program("edge(a,b)", "edge('1','2'). edge('2','3').", "path(A,B) :- edge(A,B). path(A,C) :- path(A,B),edge(B,C). loose(Z) :- edge(A,B).", "path('1',X)?")
    s = Session(spark, text, evaluate=False)
    first, second, loose = s.program.rules
    assert s.passes == 0 and str(s) == "path('1',X)? No\n"
    assert s.evaluate_rule(first) and not s.evaluate_rule(first) and not s.evaluate_rule(loose)
    assert sorted(map(tuple, s.join(second).collect())) == [("1", "2", "3")] and s.join(second).columns == ["A", "B", "C"]
    assert s.union(second.head, s.join(second)) and not s.union(Scheme("path", ("A", "Q")), s.join(second))
    assert s.evaluate_rules() == 1 and s.evaluate_rules([first]) == 1
    assert str(s) == "path('1',X)? Yes(2)\n  X='2'\n  X='3'\n" == str(Session(spark, text)) and Session(spark, text).passes == 2
    assert sorted(s.relations) == ["edge", "path"] or set(s.relations) >= {"edge", "path"}


def test_relational_primitives(spark):
    rows = spark.createDataFrame([(1, "x", 1, 5), (2, "y", 3, 5), (4, "x", 4, None)], "a int, b string, c int, d int")
    s = Session(spark, program("n(a)", "", "", "n(X)?"), {"t": rows})
    atom = parse(program("n(a)", "", "", "t(X,'x',X,Y)?")).queries[0]
    assert [r.c0 for r in s.select(atom).orderBy("c0").collect()] == [1, 4]
    assert [r.c0 for r in s.equal(atom).collect()] == [1]  # NULL is no value of Y
    assert s.project(atom).columns == ["c0", "c3"] and s.project(atom).count() == 3
    assert s.rename(atom).columns == ["X", "Y"]
    assert [tuple(r) for r in s.evaluate_query(atom).collect()] == [(1, 5)]
    assert s.evaluate_query(parse(program("n(a)", "", "", "ghost(X)?")).queries[0]).count() == 0


def test_unsafe_rules(spark):
    text = program("a(x)", "a('1').", "b(Y):-a(X). b(X):-a(X).", "b(X)?")
    with pytest.warns(UnsafeRuleWarning):
        assert answers(spark, text) == [1]
    with pytest.raises(ValueError, match="unsafe"):
        Engine(spark, strict=True).run(text)


def test_reports(spark, tmp_path, capsys):
    text = program("p(n,h)", "p('b','it''s'). p('a','y').", "q(H,N):-p(N,H).", "q(H,N)? p('a','y')? p('a','z')?")
    expected = "q(H,N)? Yes(2)\n  H='it''s', N='b'\n  H='y', N='a'\np('a','y')? Yes(1)\np('a','z')? No\n"
    run = Engine(spark).run
    assert report.interpreter_report(run(text, evaluation="interpreter", mode="compat")) == "Schemes populated after 2 passes through the Rules.\n" + expected
    assert report.optimizer_report(run(text, mode="compat")) == "Dependency Graph\nR0:\n\nRule Evaluation\n1 passes: R0\n\nQuery Evaluation\n" + expected
    f = tmp_path / "p.txt"
    f.write_text(text)
    assert main(["interpret", str(f)]) == 0 and capsys.readouterr().out.endswith(expected)
    assert main(["relational", str(f)]) == 0 and capsys.readouterr().out.startswith("q(H,N)? No\np('a','y')? Yes(1)")


def test_tables_keep_types_and_push_filters(spark, tmp_path):
    spark.createDataFrame([(1, "x", 5), (2, "y", None), (10, "01", 10)], "k int, s string, v long").write.parquet(str(tmp_path / "t"))
    engine = Engine(spark).register("t", spark.read.parquet(str(tmp_path / "t")), ["k", "s", "v"])
    df = engine.query(program("n(a)", "", "", "t('1',S,V)?"))
    assert [tuple(r) for r in df.collect()] == [("x", 5)]
    plan = df._jdf.queryExecution().toString()
    assert "EqualTo(k,1)" in plan
    assert engine.query(program("n(a)", "", "", "t('01',S,V)?")).count() == 0  # text of no int
    assert engine.query(program("n(a)", "", "", "t(K,S,V)?")).count() == 2  # NULL in a bound column
    assert engine.query(program("n(a)", "", "", "t(X,S,X)?")).collect()[0][0] == 10  # int and long meet as long
    with pytest.raises(TypeError):
        Engine(spark).register("t", spark.createDataFrame([([1],)], "a array<int>"))


def brute(p):
    data = {}
    for f in p.facts:
        data.setdefault(f.name, set()).add(f.values)

    def match(atom, env):
        for row in data.get(atom.name, ()):
            new = dict(env)
            for t, v in zip(atom.terms, row, strict=False):
                if hasattr(t, "value"):
                    if t.value != v:
                        break
                elif new.setdefault(t.name, v) != v:
                    break
            else:
                yield new

    changed = True
    while changed:
        changed = False
        for r in p.rules:
            envs = [{}]
            for a in r.body:
                envs = [n for e in envs for n in match(a, e)]
            new = {tuple(e[v] for v in r.head.columns) for e in envs} - data.get(r.head.name, set())
            if new:
                data.setdefault(r.head.name, set()).update(new)
                changed = True
    return [{tuple(e[v] for v in q.variables) for e in match(q, {})} for q in p.queries]


@pytest.mark.parametrize("seed", range(6))
def test_random_programs(spark, seed):
    rng = random.Random(seed)
    names = ["p", "q", "r"]
    facts = " ".join(f"{rng.choice(names[:2])}('{rng.randrange(4)}','{rng.randrange(4)}')." for _ in range(6))

    def term():
        return rng.choice(["X", "Y", "Z", "X", "Y", "'1'"])

    rules = []
    for _ in range(4):
        body = [f"{rng.choice(names)}({term()},{term()})" for _ in range(rng.randint(1, 3))]
        free = sorted({c for b in body for c in b if c in "XYZ"}) or ["X"]
        if not any(c in b for b in body for c in "XYZ"):
            body.append("p(X,Y)")
            free = ["X", "Y"]
        rules.append(f"{rng.choice(names)}({rng.choice(free)},{rng.choice(free)}) :- {','.join(body)}.")
    text = program("p(a,b) q(a,b) r(a,b)", facts, " ".join(rules), "p(A,B)? q(A,A)? r(A,'1')?")
    expected = brute(parse(text))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for evaluation, mode in (("interpreter", "compat"), ("optimized", "fast")):
            got = [{tuple(r) for r in q.df.collect()} for q in Engine(spark).run(text, evaluation=evaluation, mode=mode).queries]
            assert got == expected, text
