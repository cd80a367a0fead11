"""Program text from files. A missing file is an error, never an empty program."""

from __future__ import annotations

from functools import reduce
from pathlib import Path

from hornspark.plans.nodes import Program
from hornspark.plans.parser import parse


def read_text(path: str) -> str:
    return Path(path).read_text(encoding="utf-8")


def read_program(*paths: str) -> Program:
    """One program of all files' sections, in the order given."""
    return reduce(lambda a, b: a + b, (parse(read_text(p)) for p in paths))


def write_program(program: Program, path: str) -> None:
    Path(path).write_text(program.canonical() + "\n", encoding="utf-8")
