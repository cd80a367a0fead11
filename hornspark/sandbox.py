"""All layers of one program side by side, evaluated again whenever its text changes.

``python -m hornspark.sandbox FILE`` prints the panes and watches the file. Lines typed meanwhile are commands: ``pause`` (and on again), ``comments``
and ``whitespace`` (shown among the tokens or not), ``save PATH`` (the program, sections sorted), ``quit``. ``--other LAYER=PROGRAM`` puts
another implementation's output beside ours, each with a time limit.
"""

from __future__ import annotations

import argparse
import sys
import tempfile
import threading
import time
from collections.abc import Callable, Iterable, Mapping
from pathlib import Path

from pyspark.sql import SparkSession

from hornspark import report
from hornspark.compare import LAYERS, theirs
from hornspark.engine import Engine
from hornspark.plans.lexer import tokenize
from hornspark.plans.nodes import Program
from hornspark.plans.parser import DatalogSyntaxError, parse

TITLES = dict(zip(LAYERS, ("tokens", "parse", "relational", "interpreter", "optimizer"), strict=True))
TIMEOUT = 2.0


class Sandbox:
    """``update`` returns what each layer says of a text. While paused, or for a text it has just seen, it returns the former panes.

    ``layers`` are those shown; ``others`` are commands by layer, whose output stands in panes of their own.
    """

    def __init__(self, spark: SparkSession, *, keep_comments: bool = True, keep_whitespace: bool = False, layers: Iterable[str] = LAYERS, others: Mapping[str, list[str]] | None = None, timeout: float = TIMEOUT):
        self.spark, self.keep_comments, self.keep_whitespace, self.paused = spark, keep_comments, keep_whitespace, False
        self.layers, self.others, self.timeout = tuple(layers), dict(others or {}), timeout
        self.panes: dict[str, str] = {}
        self.program: Program | None = None
        self._seen: tuple | None = None

    def update(self, text: str) -> dict[str, str]:
        state = (text, self.keep_comments, self.keep_whitespace)
        if self.paused or state == self._seen:
            return self.panes
        self.panes, self._seen = {}, state
        try:
            self.program, error = parse(text), ""
        except DatalogSyntaxError as e:
            self.program, error = None, f"Failure!\n  {e.token}"
        for layer in self.layers:
            if layer == "lex" or layer == "parse" or self.program:
                self.panes[TITLES[layer]] = self._tokens(text) if layer == "lex" else self._evaluated(layer, self.program) if self.program else error
            if layer in self.others:
                self.panes[f"{TITLES[layer]} (other)"] = self._other(layer, text)
        return self.panes

    def _tokens(self, text: str) -> str:
        tokens = tokenize(text, keep_comments=self.keep_comments, keep_whitespace=self.keep_whitespace)
        return "\n".join([*map(str, tokens), f"Total Tokens = {len(tokens)}"])

    def _evaluated(self, layer: str, program: Program) -> str:
        run = Engine(self.spark).run
        shown: dict[str, Callable[[], str]] = {
            "parse": lambda: f"Success!\n{program}",
            "relational": lambda: report.relational_report(run(program, evaluation="relational")),
            "interpret": lambda: report.interpreter_report(run(program, evaluation="interpreter", mode="compat")),
            "optimize": lambda: report.optimizer_report(run(program, evaluation="optimized", mode="compat")),
        }
        return shown[layer]()

    def _other(self, layer: str, text: str) -> str:
        with tempfile.NamedTemporaryFile("w", suffix=".txt") as f:
            f.write(text)
            f.flush()
            ran = theirs(self.others[layer], f.name, self.timeout)
        return ran.out if ran.status == "ok" else f"[{ran.status}] {ran.out}"

    def command(self, line: str) -> bool:
        """Do what a typed line says; False to end."""
        word, _, rest = line.strip().partition(" ")
        if word == "pause":
            self.paused = not self.paused
        elif word == "comments":
            self.keep_comments = not self.keep_comments
        elif word == "whitespace":
            self.keep_whitespace = not self.keep_whitespace
        elif word == "save" and rest and self.program:
            Path(rest).write_text(self.program.canonical() + "\n", encoding="utf-8")
        return word != "quit"


def main(argv: list[str] | None = None) -> None:
    from hornspark.cli import session

    arg = argparse.ArgumentParser(prog="hornspark.sandbox", description=__doc__)
    arg.add_argument("file")
    arg.add_argument("--once", action="store_true", help="print the panes and end")
    arg.add_argument("--ignore-comments", action="store_true", help="leave comments out of the tokens")
    arg.add_argument("--keep-whitespace", action="store_true", help="show white space among the tokens")
    arg.add_argument("--layers", nargs="+", choices=LAYERS, default=LAYERS)
    arg.add_argument("--other", action="append", default=[], metavar="LAYER=PROGRAM")
    arg.add_argument("--timeout", type=float, default=TIMEOUT, help="seconds for another program")
    args = arg.parse_args(argv)
    others = {layer: [program] for layer, _, program in (x.partition("=") for x in args.other)}
    if not set(others) <= set(LAYERS):
        arg.error(f"--other takes one of {', '.join(LAYERS)}")
    box = Sandbox(session(), keep_comments=not args.ignore_comments, keep_whitespace=args.keep_whitespace, layers=args.layers, others=others, timeout=args.timeout)
    going = threading.Event()
    going.set()

    def listen() -> None:
        for line in sys.stdin:
            if not box.command(line):
                going.clear()
                return

    if not args.once:
        threading.Thread(target=listen, daemon=True).start()
    shown = None
    while going.is_set():
        panes = box.update(Path(args.file).read_text(encoding="utf-8"))
        if panes is not shown:
            print("".join(f"== {title} ==\n{pane}\n" for title, pane in panes.items()), flush=True)
            shown = panes
        if args.once:
            return
        time.sleep(0.5)


if __name__ == "__main__":
    main()
