"""One atom over one relation: selection, equality of repeated variables, projection, renaming, NULL removal."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hornspark.functions.values import as_type, common_type, equals_text
from hornspark.plans.nodes import Atom, Const, Var


def _positions(atom: Atom) -> dict[str, list[int]]:
    """Where each variable stands."""
    out: dict[str, list[int]] = {}
    for i, term in enumerate(atom.terms):
        if isinstance(term, Var):
            out.setdefault(term.name, []).append(i)
    return out


def _constants(df: DataFrame, atom: Atom) -> list[Column]:
    kinds = [f.dataType for f in df.schema.fields]
    some = [(i, t.value) for i, t in enumerate(atom.terms) if isinstance(t, Const)]
    return [equals_text(F.col(f"c{i}"), kinds[i], text) if i < len(kinds) else F.lit(False) for i, text in some]


def _equalities(df: DataFrame, atom: Atom) -> list[Column]:
    kinds = [f.dataType for f in df.schema.fields]
    tests = []
    for first, *others in (at for at in _positions(atom).values() if at[-1] < len(kinds)):
        for i in others:
            want = common_type(kinds[first], kinds[i])
            tests.append(as_type(F.col(f"c{first}"), kinds[first], want) == as_type(F.col(f"c{i}"), kinds[i], want))
    return tests


def _bound(df: DataFrame, atom: Atom) -> list[Column]:
    width = len(df.columns)
    return [F.col(f"c{at[0]}").isNotNull() if at[-1] < width else F.lit(False) for at in _positions(atom).values()]


def _all(tests: list[Column]) -> Column | None:
    return reduce(lambda a, b: a & b, tests) if tests else None


def _keep(df: DataFrame, tests: list[Column]) -> DataFrame:
    test = _all(tests)
    return df if test is None else df.filter(test)


def atom_filter(df: DataFrame, atom: Atom) -> Column | None:
    """All conditions of the atom as one predicate; None where it has none.

    A position past the relation's last column matches nothing. Positions the atom doesn't name are free: a
    short atom matches on the prefix. An expression matches anything.
    """
    return _all(_constants(df, atom) + _bound(df, atom) + _equalities(df, atom))


def select(df: DataFrame, atom: Atom) -> DataFrame:
    """The tuples that have the atom's constants."""
    return _keep(df, _constants(df, atom))


def equal(df: DataFrame, atom: Atom) -> DataFrame:
    """The tuples in which all positions of a variable agree."""
    return _keep(df, _bound(df, atom) + _equalities(df, atom))


def project(df: DataFrame, atom: Atom) -> DataFrame:
    """The first position of each variable; a position past the last column is NULL."""
    return df.select(*((F.col(f"c{at[0]}") if at[0] < len(df.columns) else F.lit(None).cast("string").alias(f"c{at[0]}")) for at in _positions(atom).values()))


def rename(df: DataFrame, atom: Atom) -> DataFrame:
    """A projected relation's columns named by the atom's variables, as a set."""
    return df.toDF(*atom.variables).distinct()


def evaluate_atom(df: DataFrame, atom: Atom, names: dict[str, str], keep: set[str] | None = None) -> DataFrame:
    """The atom's bindings with one column ``names[v]`` for each variable (only those in ``keep``, if given).

    Rows may repeat: whoever needs a set asks for distinct() once, as late as possible.
    """
    test = atom_filter(df, atom)
    found = df if test is None else df.filter(test)
    position: dict[str, int] = {}
    for i, term in enumerate(atom.terms):
        if isinstance(term, Var):
            position.setdefault(term.name, i)
    columns = [
        (F.col(f"c{i}") if i < len(df.columns) else F.lit(None).cast("string")).alias(names[v])
        for v, i in position.items()
        if keep is None or v in keep
    ]
    return found.select(*columns)


def is_ground(atom: Atom) -> bool:
    return not atom.variables


def answer(df: DataFrame, atom: Atom) -> DataFrame:
    """A query's distinct bindings, columns named by its variables; without variables one row ``matched`` or none."""
    if is_ground(atom):
        test = atom_filter(df, atom)
        return (df if test is None else df.filter(test)).limit(1).select(F.lit(True).alias("matched"))
    names = {v: f"v{k}" for k, v in enumerate(atom.variables)}
    return evaluate_atom(df, atom, names).distinct().toDF(*atom.variables)
