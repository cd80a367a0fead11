"""A program kept at its fixpoint while facts arrive, by hand or from a stream.

Positive programs only ever gain tuples, so a batch of new facts is one more increment of its relation: the rules run on
from where they stood and see only what came since. With Structured Streaming each micro-batch is such an increment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hornspark.engine import Engine
from hornspark.operators.atoms import answer
from hornspark.operators.fixpoint import Store, run_rules
from hornspark.plans import analysis
from hornspark.plans.nodes import Program
from hornspark.plans.parser import parse
from hornspark.sources.relations import from_table


class Incremental:
    """``tables`` are bound like those of an Engine. ``insert`` adds facts; answers are always those of the fixpoint."""

    def __init__(self, spark: SparkSession, program: Program | str, tables: dict[str, DataFrame] | None = None):
        self.program = parse(program) if isinstance(program, str) else program
        engine = Engine(spark)
        for name, df in (tables or {}).items():
            engine.register(name, df)
        self.store = Store(spark, engine.load(self.program))
        rules = self.program.rules
        graph = analysis.dependencies(rules)
        usable = {i for i, r in enumerate(rules) if analysis.is_safe(r)}
        self.components = [([rules[i] for i in c if i in usable], analysis.is_recursive(c, graph), {}) for c in analysis.components(graph)]
        self.store.prepare([rules[i] for i in sorted(usable)])
        self.store.settle()
        self._run()

    def _run(self) -> None:
        for rules, recursive, last in self.components:
            if rules:
                run_rules(self.store, rules, recursive=recursive, last=last)

    def insert(self, name: str, facts: DataFrame) -> bool:
        """Add tuples, columns by position, and all that follows from them; whether any of them was new."""
        rows = from_table(facts)
        if name not in self.store.relations:
            self.store.get(name, len(rows.columns))
        new = self.store.grow(name, [rows], nulls=True)
        if new:
            self._run()
        return new

    def follow(self, name: str, stream: DataFrame, checkpoint: str):
        """A started streaming query that inserts every micro-batch. A batch that comes twice adds nothing the second time."""
        return stream.writeStream.foreachBatch(lambda df, _: self.insert(name, df) and None).option("checkpointLocation", checkpoint).start()

    def answers(self) -> list[DataFrame]:
        return [answer(self.store.get(q.name, len(q.terms)).frame, q) for q in self.program.queries]
