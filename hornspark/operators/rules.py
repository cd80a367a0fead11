"""A rule as one DataFrame plan: joins of its body's atoms, then the head's projection.

Rows of a plan may repeat; the union into the head's relation makes a set of them once. Two rewrites keep that
cheap. A variable is carried only while the head or a later atom needs it. An atom that brings no needed
variable of its own is a test, so it becomes a semi join, which cannot multiply rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hornspark.functions.values import as_type, common_type
from hornspark.operators.atoms import evaluate_atom
from hornspark.plans.nodes import Atom, Rule


def join_order(body: Sequence[Atom], start: int) -> list[int]:
    """From ``start``, always the next atom that shares a variable with those before; tests without variables last."""
    left = [i for i in range(len(body)) if i != start]
    order, bound = [start], set(body[start].variables)
    while left:
        best = max(left, key=lambda i: (bool(bound & set(body[i].variables)), len(bound & set(body[i].variables)), bool(body[i].variables), -i))
        left.remove(best)
        order.append(best)
        bound |= set(body[best].variables)
    return order


def join(left: DataFrame, right: DataFrame, shared: list[str], how: str) -> DataFrame:
    """Equi-join on columns of the same names; unlike types meet in their common type."""
    a, b = left.schema, right.schema
    for c in shared:
        want = common_type(a[c].dataType, b[c].dataType)
        if a[c].dataType != want:
            left = left.withColumn(c, as_type(F.col(c), a[c].dataType, want))
        if b[c].dataType != want:
            right = right.withColumn(c, as_type(F.col(c), b[c].dataType, want))
    return left.join(right, shared, how)


def evaluate_body(rule: Rule, inputs: Sequence[DataFrame], start: int, names: dict[str, str]) -> DataFrame:
    order = join_order(rule.body, start if rule.body[start].variables else next((i for i, a in enumerate(rule.body) if a.variables), 0))
    need_after = [set(rule.head.columns) for _ in order]
    for k in range(len(order) - 2, -1, -1):
        need_after[k] = need_after[k + 1] | set(rule.body[order[k + 1]].variables)
    first = rule.body[order[0]]
    found, have = evaluate_atom(inputs[order[0]], first, names, need_after[0]), set(first.variables) & need_after[0]
    for k, i in list(enumerate(order))[1:]:
        atom = rule.body[i]
        mine = set(atom.variables)
        shared = [names[v] for v in atom.variables if v in have]
        new = (mine - have) & need_after[k]
        right = evaluate_atom(inputs[i], atom, names, (mine & have) | new)
        if not shared and not new:  # a test that shares nothing: does any row match?
            found = found.crossJoin(F.broadcast(right.limit(1).select(F.lit(1).alias("_guard")))).drop("_guard")
        elif not shared:
            found = found.crossJoin(right)
        elif not new:
            found = join(found, right, shared, "left_semi")
        else:
            if len((mine & have) | new) < len(inputs[i].columns):
                right = right.distinct()  # columns were dropped: their repeats would multiply
            found = join(found, right, shared, "inner")
        have = (have | new) & need_after[k]
        found = found.select(*(names[v] for v in sorted(have, key=names.get)))
    return found


def evaluate_rule(rule: Rule, inputs: Sequence[DataFrame], start: int = 0) -> DataFrame:
    """The head's tuples in columns c0, c1, ...; ``inputs`` holds a relation for each body atom, ``start`` the one to begin with."""
    names: dict[str, str] = {}
    for atom in rule.body:
        for v in atom.variables:
            names.setdefault(v, f"v{len(names)}")
    found = evaluate_body(rule, inputs, start, names)
    return found.select(*(F.col(names[v]).alias(f"c{i}") for i, v in enumerate(rule.head.columns)))
