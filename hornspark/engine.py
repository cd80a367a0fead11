"""Programs over Spark: bind tables, run, get DataFrames."""

from __future__ import annotations

import warnings
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from hornspark.functions.values import RULED, typed
from hornspark.operators.atoms import answer, is_ground
from hornspark.operators.fixpoint import Store, run_rules
from hornspark.operators.rules import evaluate_rule
from hornspark.plans import analysis, demand
from hornspark.plans.nodes import Atom, Const, Program, Rule
from hornspark.plans.parser import parse
from hornspark.sources.relations import from_facts, from_table


class UnsafeRuleWarning(UserWarning):
    """A head variable is missing from the body; the rule contributes nothing."""


@dataclass
class QueryResult:
    query: Atom
    df: DataFrame

    @property
    def ground(self) -> bool:
        return is_ground(self.query)


@dataclass
class Result:
    """``passes`` is that of the in-order fixpoint; ``components`` pairs rule numbers with their passes."""

    program: Program
    relations: dict[str, DataFrame]
    queries: list[QueryResult]
    passes: int = 0
    components: list[tuple[list[int], int]] = field(default_factory=list)


class Engine:
    """``register`` tables, then ``run`` programs.

    ``evaluation`` is "relational" (queries over base facts, rules ignored), "interpreter" (all rules in program
    order to the fixpoint) or "optimized" (component by component, dependencies first). ``mode`` is described in
    operators.fixpoint. All give the same answers but for "relational".
    """

    def __init__(self, spark: SparkSession, *, strict: bool = False):
        self.spark, self.strict, self.tables = spark, strict, {}

    def register(self, name: str, df: DataFrame, columns: Sequence[str] | None = None) -> Engine:
        """Bind chosen scalar columns, by position, to a relation name of letters and digits."""
        self.tables[name] = from_table(df, columns)
        return self

    def load(self, program: Program) -> dict[str, DataFrame]:
        """Base relations: registered tables, and the facts of declared relations. Facts of undeclared ones are ignored."""
        out = dict(self.tables)
        declared = {s.name for s in program.schemes}
        facts: dict[str, list] = {}
        for f in program.facts:
            if f.name in declared or f.name in self.tables:
                facts.setdefault(f.name, []).append(f)
        for name, some in facts.items():
            rows = from_facts(self.spark, some)
            if name in out:
                store = Store(self.spark, {})
                rows = out[name].unionByName(store.cast(rows, out[name]))
            out[name] = rows
        return out

    def run(self, program: Program | str, *, evaluation: str = "optimized", mode: str = "fast", prune: bool = False, seeds: dict[str, DataFrame] | None = None) -> Result:
        """``prune`` leaves out rules that no query needs; ``seeds`` are further base relations."""
        program = parse(program) if isinstance(program, str) else program
        if evaluation not in ("relational", "interpreter", "optimized"):
            raise ValueError(f"unknown evaluation {evaluation}")
        base = self.load(program) | (seeds or {})
        store = Store(self.spark, base, sets=set(base) - set(self.tables))
        result = Result(program, {}, [])
        if evaluation != "relational":
            wanted = analysis.reachable_rules(program) if prune else set(range(len(program.rules)))
            usable = {i for i in wanted if self._usable(program.rules[i])}
            store.prepare([program.rules[i] for i in sorted(usable)])
            if evaluation == "interpreter":
                result.passes = run_rules(store, [program.rules[i] for i in sorted(usable)], mode=mode)
            else:
                graph = analysis.dependencies(program.rules)
                read_once = self._read_once(program, graph, usable)
                for c in analysis.components(graph):
                    rules = [program.rules[i] for i in c if i in usable]
                    if mode == "fast" and rules and rules[0].head.name in read_once:
                        store.extend(rules[0].head.name, [evaluate_rule(rules[0], [store.get(a.name, len(a.terms)).frame for a in rules[0].body])])
                        result.components.append((c, 1))
                        continue
                    passes = run_rules(store, rules, recursive=analysis.is_recursive(c, graph), mode=mode) if rules else 1
                    result.components.append((c, passes))
        result.relations = {k: r.frame for k, r in store.relations.items()}
        result.queries = [QueryResult(q, answer(store.get(q.name, len(q.terms)).frame, q)) for q in program.queries]
        return result

    def query(self, program: Program | str, **options) -> DataFrame:
        """The answer to the program's last query."""
        return self.ask(program, **options).queries[-1].df

    def ask(self, program: Program | str, *, on_demand: bool = True, **options) -> Result:
        """``run`` for the last query alone. With ``on_demand`` its constants reach into recursion: only what can bear on the answer is derived."""
        program = parse(program) if isinstance(program, str) else program
        last = replace(program, queries=program.queries[-1:])
        if on_demand and not options and (found := self._demand(last)):
            rewritten, seeds = found
            return self.run(rewritten, seeds=seeds)
        return self.run(last, **{"prune": True} | options)

    def _demand(self, program: Program) -> tuple[Program, dict[str, DataFrame]] | None:
        """The program rewritten for its query's constants, and the relation of these, typed as the columns they are asked of."""
        query = program.queries[0]
        if not any(isinstance(t, Const) for t in query.terms):
            return None
        usable = [program.rules[i] for i in sorted(analysis.reachable_rules(program)) if self._usable(program.rules[i])]
        base = self.load(program)
        kinds = Store(self.spark, {k: df.limit(0) for k, df in base.items()}).kinds(usable)
        column = dict(enumerate(kinds.get(query.name, [])))
        # Only of these types is it known how they write a value; a text that they never write is asked of nothing.
        ruled = {i: t.value for i, t in enumerate(query.terms) if isinstance(t, Const) and i in column and isinstance(column[i], RULED)}
        found = demand.demanded(replace(program, rules=tuple(usable)), query, {(query.name, i) for i in ruled}, set(base))
        if found is None:
            return None
        schema = T.StructType([T.StructField(f"c{k}", column[i]) for k, (i, _) in enumerate(found.seeds)])
        values = tuple(typed(text, column[i]) for i, text in found.seeds)
        return found.program, {found.relation: self.spark.createDataFrame([] if None in values else [values], schema)}

    @staticmethod
    def _read_once(program: Program, graph: list[list[int]], usable: set[int]) -> set[str]:
        """Heads of rules without recursion that are read at most once, and then not in a loop: they need no written table."""
        recursive = {i for c in analysis.components(graph) if analysis.is_recursive(c, graph) for i in c}
        reads = Counter(a.name for i in usable for a in program.rules[i].body)
        reads.update(q.name for q in program.queries)
        looped = {a.name for i in recursive for a in program.rules[i].body} | {program.rules[i].head.name for i in recursive}
        return {program.rules[i].head.name for i in usable if reads[program.rules[i].head.name] <= 1} - looped

    def _usable(self, rule: Rule) -> bool:
        if analysis.is_safe(rule):
            return True
        if self.strict:
            raise ValueError(f"unsafe rule: {rule}")
        warnings.warn(f"skipped, since a head variable is missing from the body: {rule}", UnsafeRuleWarning, stacklevel=3)
        return False
