"""Syntax tree of a Datalog program. Everything here lives on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field


def quote(value: str) -> str:
    """The source form of a constant: quotes doubled inside, one pair around."""
    return "'" + value.replace("'", "''") + "'"


@dataclass(frozen=True)
class Const:
    value: str

    def __str__(self) -> str:
        return quote(self.value)


@dataclass(frozen=True)
class Var:
    name: str

    def __str__(self) -> str:
        return self.name


@dataclass(frozen=True)
class Expr:
    """``(left op right)``. It parses but is never computed: as a parameter it matches anything."""

    left: Term
    op: str
    right: Term

    def __str__(self) -> str:
        return f"({self.left}{self.op}{self.right})"


Term = Const | Var | Expr


@dataclass(frozen=True)
class Atom:
    name: str
    terms: tuple[Term, ...]

    def __str__(self) -> str:
        return f"{self.name}({','.join(map(str, self.terms))})"

    @property
    def variables(self) -> list[str]:
        """Distinct variable names, in order of first occurrence."""
        return list(dict.fromkeys(t.name for t in self.terms if isinstance(t, Var)))


@dataclass(frozen=True)
class Scheme:
    """A declared relation, and also the head of a rule: only identifiers as parameters."""

    name: str
    columns: tuple[str, ...]

    def __str__(self) -> str:
        return f"{self.name}({','.join(self.columns)})"


@dataclass(frozen=True)
class Fact:
    name: str
    values: tuple[str, ...]

    def __str__(self) -> str:
        return f"{self.name}({','.join(map(quote, self.values))})."


@dataclass(frozen=True)
class Rule:
    head: Scheme
    body: tuple[Atom, ...]

    def __str__(self) -> str:
        return f"{self.head} :- {','.join(map(str, self.body))}."


@dataclass(frozen=True)
class Program:
    schemes: tuple[Scheme, ...] = ()
    facts: tuple[Fact, ...] = ()
    rules: tuple[Rule, ...] = ()
    queries: tuple[Atom, ...] = ()
    domain: tuple[str, ...] = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "domain", tuple(sorted({v for f in self.facts for v in f.values}, key=quote)))

    def __add__(self, other: Program) -> Program:
        """Both programs' sections, one after the other; neither operand changes."""
        return Program(self.schemes + other.schemes, self.facts + other.facts, self.rules + other.rules, self.queries + other.queries)

    def canonical(self) -> str:
        """Program text with every section free of duplicates and sorted."""
        lines = []
        for title, items in (("Schemes", self.schemes), ("Facts", self.facts), ("Rules", self.rules), ("Queries", [f"{q}?" for q in self.queries])):
            lines.append(f"{title}:\n  " + "\n  ".join(sorted({str(x) for x in items})))
        return "\n".join(lines)

    def __str__(self) -> str:
        """The parser's dump: counted sections in source order, then the sorted domain."""
        out = []
        for title, items in (
            ("Schemes", self.schemes),
            ("Facts", self.facts),
            ("Rules", self.rules),
            ("Queries", [f"{q}?" for q in self.queries]),
            ("Domain", [quote(v) for v in self.domain]),
        ):
            out.append("\n".join([f"{title}({len(items)}):", *(f"  {x}" for x in items)]))
        return "\n".join(out)
