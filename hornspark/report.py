"""Results as text. Rows come to the driver one partition at a time, already sorted."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import functions as F

from hornspark.engine import QueryResult, Result
from hornspark.plans.analysis import graph_report
from hornspark.plans.nodes import quote


def query_lines(result: QueryResult) -> Iterator[str]:
    """``atom? No``, or ``atom? Yes(n)`` and the bindings, sorted by their quoted text column by column."""
    if result.ground:
        yield f"{result.query}? {'No' if result.df.isEmpty() else 'Yes(1)'}"
        return
    names = result.query.variables
    texts = result.df.toDF(*(f"v{i}" for i in range(len(names))))
    quoted = texts.select(*(F.concat(F.lit("'"), F.replace(F.col(c).cast("string"), F.lit("'"), F.lit("''")), F.lit("'")).alias(c) for c in texts.columns))
    count = quoted.count()
    if not count:
        yield f"{result.query}? No"
        return
    yield f"{result.query}? Yes({count})"
    for row in quoted.orderBy(*quoted.columns).toLocalIterator():
        yield "  " + ", ".join(f"{n}={v}" for n, v in zip(names, row, strict=True))


def relational_report(result: Result) -> str:
    return "".join(f"{line}\n" for q in result.queries for line in query_lines(q))


def interpreter_report(result: Result) -> str:
    return f"Schemes populated after {result.passes} passes through the Rules.\n" + relational_report(result)


def optimizer_report(result: Result) -> str:
    rules = result.program.rules
    out = "Dependency Graph\n" + graph_report(rules) + "\n" + ("\n" if rules else "")
    out += "Rule Evaluation\n" + "".join(f"{n} passes: {','.join(f'R{i}' for i in c)}\n" for c, n in result.components) + "\n"
    return out + "Query Evaluation\n" + relational_report(result)


__all__ = ["interpreter_report", "optimizer_report", "query_lines", "quote", "relational_report"]
