"""A program's relations and rules, step by step: what the engine does at once can here be asked for piece by piece."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hornspark import report
from hornspark.engine import Engine, QueryResult, Result
from hornspark.operators import atoms
from hornspark.operators.fixpoint import Store, run_rules
from hornspark.operators.rules import evaluate_rule
from hornspark.plans.analysis import is_safe
from hornspark.plans.nodes import Atom, Program, Rule, Scheme
from hornspark.plans.parser import parse


class Session:
    """``tables`` are bound by position. With ``evaluate`` the rules run to their fixpoint and the queries are answered at once;
    without it only base facts are there, until rules are evaluated by hand.
    """

    def __init__(self, spark: SparkSession, program: Program | str, tables: dict[str, DataFrame] | None = None, *, evaluate: bool = True):
        self.program = parse(program) if isinstance(program, str) else program
        engine = Engine(spark)
        for name, df in (tables or {}).items():
            engine.register(name, df)
        base = engine.load(self.program)
        self.store = Store(spark, base, sets=set(base) - set(engine.tables))
        self.rules = [r for r in self.program.rules if is_safe(r)]
        self.store.prepare(self.rules)
        self.passes = self.evaluate_rules() if evaluate else 0

    # --- relations ---

    @property
    def relations(self) -> dict[str, DataFrame]:
        return {k: r.frame for k, r in self.store.relations.items()}

    def relation(self, atom: Atom) -> DataFrame:
        """The relation an atom speaks of, its columns c0, c1, ...; an unknown one is empty."""
        return self.store.get(atom.name, len(atom.terms)).frame

    def select(self, atom: Atom) -> DataFrame:
        return atoms.select(self.relation(atom), atom)

    def equal(self, atom: Atom) -> DataFrame:
        return atoms.equal(self.relation(atom), atom)

    def project(self, atom: Atom) -> DataFrame:
        return atoms.project(self.relation(atom), atom)

    def rename(self, atom: Atom) -> DataFrame:
        return atoms.rename(self.project(atom), atom)

    def evaluate_query(self, atom: Atom) -> DataFrame:
        return atoms.answer(self.relation(atom), atom)

    # --- rules ---

    def join(self, rule: Rule) -> DataFrame:
        """The bindings of all of a body's variables, a column for each."""
        names = list(dict.fromkeys(v for a in rule.body for v in a.variables))
        whole = Rule(Scheme(rule.head.name, tuple(names)), rule.body)
        return evaluate_rule(whole, [self.relation(a) for a in rule.body]).distinct().toDF(*names)

    def union(self, head: Scheme, found: DataFrame) -> bool:
        """Add ``found``, projected to the head's variables, to the head's relation; whether that grew. Without such columns nothing is added."""
        if not set(head.columns) <= set(found.columns):
            return False
        rows = found.select(*(F.col(f"`{v}`").alias(f"c{i}") for i, v in enumerate(head.columns)))
        if head.name not in self.store.relations:
            self.store.get(head.name, len(head.columns))
        return self.store.grow(head.name, [rows], nulls=True)

    def evaluate_rule(self, rule: Rule) -> bool:
        """One rule once; whether it found anything new."""
        return is_safe(rule) and self.union(rule.head, self.join(rule))

    def evaluate_rules(self, rules: Iterable[Rule] | None = None) -> int:
        """Rules in their order, all of the program's unless given, until nothing changes; the number of passes."""
        return run_rules(self.store, [r for r in rules if is_safe(r)] if rules is not None else self.rules, mode="compat")

    # --- answers ---

    @property
    def answers(self) -> list[QueryResult]:
        return [QueryResult(q, self.evaluate_query(q)) for q in self.program.queries]

    def __str__(self) -> str:
        return report.relational_report(Result(self.program, self.relations, self.answers))
