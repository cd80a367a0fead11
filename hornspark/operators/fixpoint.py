"""The least fixpoint: a driver loop over written tables.

Each relation grows by increments, one written table for every evaluation that found something new. A rule
sees, at one recursive position at a time, only the increments younger than its own last run, before it the older ones and after it
the whole relation, so no tuple is derived from the same tuples twice. ``compat`` evaluates the rules one by
one in program order, each seeing what the former found in the same pass, and counts passes up to and including the first
without change. ``fast`` derives all rules of a component in one job per head and round, all heads at once; there are fewer,
larger jobs.

What a loop only reads is written once before it, pruned to the columns it needs. Increments are merged when there are many, those of like size first, so a
tuple is rewritten a logarithmic number of times. Tables of BUCKET_ROWS and more are dealt into buckets by all their columns, so the test
of what is new shuffles what was derived, and of the relation at most its small recent increments. How many rows an increment has is counted by its write.
"""

from __future__ import annotations

from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hornspark.functions.values import as_type, common_type
from hornspark.operators.rules import evaluate_rule
from hornspark.plans.nodes import Rule
from hornspark.sources.relations import empty
from hornspark.sources.scratch import Scratch

#: A relation of more increments than this has some of them merged, lest its scans open ever more files.
COMPACT_AFTER = 12
#: From this size on tables of a loop are bucketed.
BUCKET_ROWS = 1_000_000


@dataclass
class Part:
    epoch: int
    df: DataFrame
    rows: int | None = None  # None: not known
    bucketed: bool = False


class Relation:
    def __init__(self, base: DataFrame, is_set: bool, rows: int | None = None):
        self.parts = [Part(0, base, rows)]
        self.is_set = is_set

    @staticmethod
    def united(parts: list[Part]) -> DataFrame | None:
        some = [p.df for p in parts if p.rows != 0]
        return reduce(DataFrame.unionByName, some) if some else None

    @property
    def frame(self) -> DataFrame:
        found = self.united(self.parts)
        return self.parts[0].df if found is None else found

    @property
    def known_empty(self) -> bool:
        return all(p.rows == 0 for p in self.parts)

    def since(self, epoch: int) -> DataFrame | None:
        return self.united([p for p in self.parts if p.epoch > epoch])

    def until(self, epoch: int) -> DataFrame | None:
        return self.united([p for p in self.parts if p.epoch <= epoch])


class Store:
    """All relations of a run by name."""

    def __init__(self, spark: SparkSession, relations: dict[str, DataFrame], sets: Iterable[str] = ()):
        self.spark, self.epoch, self.scratch = spark, 0, Scratch(spark)
        self.relations = {k: Relation(df, k in set(sets)) for k, df in relations.items()}
        self.fixed: dict[str, DataFrame] = {}
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def get(self, name: str, arity: int) -> Relation:
        if name not in self.relations:
            self.relations[name] = Relation(empty(self.spark, arity), True, 0)
        return self.relations[name]

    def cast(self, df: DataFrame, like: DataFrame) -> DataFrame:
        """``df`` with the column types of ``like``; missing columns are NULL."""
        have = df.schema.fields
        return df.select(*((as_type(F.col(f.name), have[i].dataType, f.dataType) if i < len(have) else F.lit(None).cast(f.dataType)).alias(f.name) for i, f in enumerate(like.schema.fields)))

    def kinds(self, rules: list[Rule], filled: Iterable[str] = ()) -> dict[str, list[T.DataType]]:
        """Column types of all relations as far as they are known: of heads those that all their sources can share. Heads in ``filled`` keep what they hold."""
        kinds = {k: [f.dataType for f in r.frame.schema.fields] for k, r in self.relations.items()}
        for r in rules:
            if r.head.name not in filled:
                kinds.pop(r.head.name, None)
        changed = True
        while changed:
            changed = False
            for r in rules:
                var: dict[str, T.DataType] = {}
                for a in r.body:
                    for term, kind in zip(a.terms, kinds.get(a.name, [])):
                        name = getattr(term, "name", None)
                        if name is not None:
                            var[name] = common_type(var[name], kind) if name in var else kind
                mine = [var.get(v) for v in r.head.columns]
                if any(x is None for x in mine):
                    continue  # nothing is known yet of a source
                old = kinds.get(r.head.name)
                new = mine if old is None else [common_type(a, b) if a is not None and b is not None else a or b for a, b in zip(old + [None] * len(mine), mine + [None] * (len(old) - len(mine)))][: max(len(old), len(mine))]
                if new != old:
                    kinds[r.head.name], changed = new, True
        return kinds

    def prepare(self, rules: Iterable[Rule]) -> None:
        """Give every head's relation the arity and types that all its sources can share, before anything is derived."""
        rules = list(rules)
        heads = {r.head.name for r in rules}
        filled = {k for k, r in self.relations.items() if k in heads and not r.known_empty and not r.frame.isEmpty()}
        kinds = self.kinds(rules, filled)
        for r in rules:
            name = r.head.name
            schema = T.StructType([T.StructField(f"c{i}", k) for i, k in enumerate(kinds.get(name) or [T.StringType()] * len(r.head.columns))])
            relation = self.relations.get(name)
            if relation is None or name not in filled:
                self.relations[name] = Relation(self.spark.createDataFrame([], schema), True, 0)
            elif relation.frame.schema != schema:
                like = self.spark.createDataFrame([], schema)
                relation.parts = [Part(p.epoch, self.cast(p.df, like), p.rows) for p in relation.parts]

    def fix(self, rules: list[Rule]) -> None:
        """Write what a loop starts from and what it only reads, once: a plan may be long, and every round would run it again.

        Of what is only read, columns that no rule names are left out.
        """
        heads = {r.head.name for r in rules}
        self.fixed = {}
        for name in heads:
            relation = self.relations[name]
            relation.parts = [p if p.rows is not None else Part(p.epoch, *self._write(p.df, 0)) for p in relation.parts]
        named: dict[str, set[int]] = {}
        for a in (a for r in rules for a in r.body if a.name not in heads):
            named.setdefault(a.name, set()).update(i for i, t in enumerate(a.terms) if not hasattr(t, "op"))
        for name, wanted in named.items():
            relation = self.relations.get(name)
            if relation is None or relation.known_empty:
                continue
            kinds = relation.frame.schema.fields
            pruned = relation.frame.select(*(F.col(f.name) if i in wanted else F.lit(None).cast(f.dataType).alias(f.name) for i, f in enumerate(kinds)))
            self.fixed[name] = self.scratch.write(pruned.distinct() if len(wanted) < len(kinds) else pruned)

    def settle(self) -> None:
        """Write every relation once, whole: for programs that facts are still added to."""
        for r in self.relations.values():
            r.parts = [p if p.rows == 0 else Part(p.epoch, self.scratch.write(p.df), p.rows) for p in r.parts]

    def input(self, name: str, arity: int) -> DataFrame:
        return self.fixed[name] if name in self.fixed else self.get(name, arity).frame

    def fresh(self, name: str, derived: list[DataFrame], *, nulls: bool = False) -> DataFrame:
        """The different tuples of ``derived`` that the relation hasn't got; ``nulls`` tells that there may be NULLs, which count as equal here."""
        relation = self.relations[name]
        like = relation.parts[0].df
        new = reduce(DataFrame.unionByName, (self.cast(d, like) for d in derived)).distinct()
        nulls = nulls or any(len(d.columns) < len(like.columns) for d in derived)
        # A bucketed table needs no shuffle, but a union of such tables would: each is a join of its own.
        plain = relation.united([p for p in relation.parts if not p.bucketed])
        for total in [p.df for p in relation.parts if p.bucketed and p.rows] + ([plain] if plain is not None else []):
            if nulls:
                test = reduce(lambda a, b: a & b, (F.col(f"n.{c}").eqNullSafe(F.col(f"t.{c}")) for c in like.columns))
                new = new.alias("n").join(total.alias("t"), test, "left_anti")
            else:
                new = new.join(total, like.columns, "left_anti")
        return new

    def _write(self, df: DataFrame, expected: int) -> tuple[DataFrame, int, bool]:
        large = expected >= BUCKET_ROWS
        out, rows = self.scratch.write_counted(df, self.buckets if large else 0)
        if rows >= BUCKET_ROWS and not large:  # larger than expected: dealt into buckets once, not shuffled in every later round
            return *self.scratch.write_counted(out, self.buckets), True
        return out, rows, large

    def grow_all(self, derived: dict[str, list[DataFrame]], *, nulls: bool = False) -> bool:
        """Unions of sets, all at once: keep what is new, say whether anything is."""
        plans = {name: self.fresh(name, plans, nulls=nulls) for name, plans in derived.items()}
        expected = {name: self.relations[name].parts[-1].rows or 0 for name in plans}

        def write(name: str) -> tuple[DataFrame, int, bool]:
            return self._write(plans[name], expected[name])

        if len(plans) > 1:
            with ThreadPoolExecutor(len(plans)) as pool:
                written = dict(zip(plans, pool.map(inheritable_thread_target(self.spark)(write), plans), strict=True))
        else:
            written = {name: write(name) for name in plans}
        changed = False
        for name, (df, rows, bucketed) in written.items():
            if rows:
                self.epoch += 1
                self.relations[name].parts.append(Part(self.epoch, df, rows, bucketed))
                changed = True
        return changed

    def grow(self, name: str, derived: list[DataFrame], *, nulls: bool = False) -> bool:
        return self.grow_all({name: derived}, nulls=nulls)

    def extend(self, name: str, derived: list[DataFrame]) -> None:
        """Union of sets as a plan only, for a relation read at most once: the optimizer then sees through it."""
        relation = self.relations[name]
        like = relation.parts[0].df
        plans = [self.cast(d, like) for d in derived]
        old = [] if relation.known_empty else [relation.frame]
        self.epoch += 1
        relation.parts = [Part(self.epoch, reduce(DataFrame.unionByName, old + plans).distinct())]

    def compact(self, name: str, seen: int) -> None:
        """Merge the latest increments that every rule has seen, with those before them as long as these aren't much larger than all after them."""
        relation = self.relations[name]
        old = [p for p in relation.parts if p.epoch <= seen and p.rows is not None]
        if len(old) <= COMPACT_AFTER:
            return
        k, total = len(old) - 1, old[-1].rows
        while k and (old[k - 1].rows <= 2 * total or len(old) - k < COMPACT_AFTER // 2):
            k -= 1
            total += old[k].rows
        merged, rows, bucketed = self._write(reduce(DataFrame.unionByName, (p.df for p in old[k:] if p.rows)), total)
        gone = {id(p) for p in old[k:]}
        place = next(i for i, p in enumerate(relation.parts) if id(p) == id(old[-1]))
        relation.parts[place] = Part(old[-1].epoch, merged, rows, bucketed)
        relation.parts = [p for p in relation.parts if id(p) not in gone]


def _derive(store: Store, rule: Rule, last: int | None) -> list[DataFrame]:
    """Plans for what the rule may add since epoch ``last`` (None: never ran)."""
    relations = [store.get(a.name, len(a.terms)) for a in rule.body]
    whole = [store.input(a.name, len(a.terms)) for a in rule.body]
    if last is None:
        return [evaluate_rule(rule, whole)]
    out = []
    for i, r in enumerate(relations):
        young = r.since(last)
        if young is None or rule.body[i].name in store.fixed:
            continue
        before = [s.until(last) if s.since(last) is not None else df for s, df in zip(relations[:i], whole[:i])]
        if all(df is not None for df in before):
            out.append(evaluate_rule(rule, [*before, young, *whole[i + 1 :]], start=i))
    return out


def run_rules(store: Store, rules: list[Rule], *, recursive: bool = True, mode: str = "fast", last: dict[int, int | None] | None = None) -> int:
    """Evaluate until nothing changes; the number of passes. Without recursion one pass is enough.

    ``last`` keeps, from one call to the next, the epoch of each rule's last run; rules then see only what came since.
    """
    if mode not in ("fast", "compat"):
        raise ValueError(f"mode is fast or compat, not {mode}")
    kept = last is not None
    last = last if kept else {}
    for i in range(len(rules)):
        last.setdefault(i, None)
    store.fixed = {}
    if recursive and not kept:
        store.fix(rules)
    passes = 0
    while True:
        passes += 1
        changed = False
        if mode == "compat":
            for i, rule in enumerate(rules):
                before = store.epoch
                if plans := _derive(store, rule, last[i]):
                    changed |= store.grow(rule.head.name, plans)
                last[i] = before
        else:
            before = store.epoch
            by_head: dict[str, list[DataFrame]] = {}
            for i, rule in enumerate(rules):
                by_head.setdefault(rule.head.name, []).extend(_derive(store, rule, last[i]))
                last[i] = before
            if by_head := {name: plans for name, plans in by_head.items() if plans}:
                changed |= store.grow_all(by_head)
        for name in {r.head.name for r in rules}:
            store.compact(name, min((x for x in last.values() if x is not None), default=0))
        if not changed or not recursive:
            return passes
