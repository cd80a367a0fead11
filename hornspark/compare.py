"""Another implementation's output against ours, file by file.

``python -m hornspark.compare PROGRAM FILE...`` runs PROGRAM on each file while ours runs, too, and compares texts without regard to white space. Which
layer PROGRAM implements is found by trying, unless told: it is the one whose report on a small program equals, or is most like, what PROGRAM prints.
A file's outcome is equal, different, crashed or timeout; none of them ends the run. With ``--bound X`` PROGRAM may take X times as long as ours.
"""

from __future__ import annotations

import argparse
import subprocess
import sys
import tempfile
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from difflib import SequenceMatcher
from pathlib import Path

from hornspark import report
from hornspark.plans.lexer import token_report
from hornspark.plans.parser import DatalogSyntaxError, parse, parse_report

LAYERS = ("lex", "parse", "relational", "interpret", "optimize")
#: Every layer says something else of it.
TRIAL = """Schemes: road(From,To)
Facts: road('Bern','Chur'). road('Chur','Davos').
Rules: back(B,A) :- road(A,B).
Queries: road('Bern',X)? back(X,Y)?
"""
TIMEOUT = 60.0


def ours(layer: str, text: str) -> str:
    if layer == "lex":
        return token_report(text)
    if layer == "parse":
        return parse_report(text)
    try:
        program = parse(text)
    except DatalogSyntaxError as e:
        return f"Failure!\n  {e.token}"
    from hornspark.cli import session
    from hornspark.engine import Engine

    evaluation, render = {"relational": ("relational", report.relational_report), "interpret": ("interpreter", report.interpreter_report), "optimize": ("optimized", report.optimizer_report)}[layer]
    return render(Engine(session()).run(program, evaluation=evaluation, mode="compat"))


@dataclass
class Ran:
    """``status`` is ok, crashed or timeout."""

    status: str
    out: str
    seconds: float


def theirs(command: list[str], path: str, timeout: float = TIMEOUT) -> Ran:
    began = time.time()
    try:
        done = subprocess.run([*command, path], capture_output=True, text=True, timeout=timeout, check=False)
    except subprocess.TimeoutExpired:
        return Ran("timeout", "", time.time() - began)
    except OSError as e:
        return Ran("crashed", str(e), time.time() - began)
    # A program may well end with 1 to say that a text doesn't parse.
    failed = done.returncode < 0 or done.returncode > 1 or done.returncode == 1 and not done.stdout.lstrip().startswith("Failure")
    return Ran("crashed" if failed else "ok", done.stdout, time.time() - began)


def squeezed(text: str) -> str:
    return "".join(text.split())


def detect(command: list[str], timeout: float = TIMEOUT) -> str:
    """The layer whose report on the trial program is what the other program prints, or the nearest to it."""
    with tempfile.NamedTemporaryFile("w", suffix=".txt") as f:
        f.write(TRIAL)
        f.flush()
        got = squeezed(theirs(command, f.name, timeout).out)
    likeness = {layer: SequenceMatcher(None, got, squeezed(ours(layer, TRIAL)), autojunk=False).ratio() for layer in LAYERS}
    return max(LAYERS, key=likeness.__getitem__)


@dataclass
class Outcome:
    """``status`` is equal, different, crashed or timeout; ``slow`` tells that the bound on its time was passed."""

    file: str
    status: str
    their_seconds: float
    our_seconds: float
    slow: bool = False

    @property
    def equal(self) -> bool:
        return self.status == "equal"


def _timed(work: Callable[[], str]) -> tuple[str, float]:
    began = time.time()
    return work(), time.time() - began


def compare(command: list[str], files: list[str], layer: str | None = None, *, timeout: float = TIMEOUT, bound: float | None = None) -> list[Outcome]:
    layer = layer or detect(command, timeout)
    out = []
    with ThreadPoolExecutor(1) as pool:
        for f in files:
            running = pool.submit(theirs, command, f, timeout)
            want, seconds = _timed(lambda f=f: ours(layer, Path(f).read_text(encoding="utf-8")))
            got = running.result()
            status = got.status if got.status != "ok" else "equal" if squeezed(got.out) == squeezed(want) else "different"
            out.append(Outcome(f, status, got.seconds, seconds, bound is not None and got.seconds > bound * seconds))
    return out


def main(argv: list[str] | None = None) -> int:
    arg = argparse.ArgumentParser(prog="hornspark.compare", description=__doc__)
    arg.add_argument("-l", "--layer", choices=LAYERS)
    arg.add_argument("-s", "--name", default="", help="what to call the other program in the output")
    arg.add_argument("-t", "--timeout", type=float, default=TIMEOUT, help="seconds a file")
    arg.add_argument("--bound", type=float, help="most time the other program may take, as a multiple of ours")
    arg.add_argument("program")
    arg.add_argument("files", nargs="+")
    args = arg.parse_args(argv)
    found = compare([args.program], args.files, args.layer, timeout=args.timeout, bound=args.bound)
    for o in found:
        print(f"{o.status.upper()}{' SLOW' if o.slow else ''}  {o.file}  {args.name or args.program} {o.their_seconds:.2f} s, ours {o.our_seconds:.2f} s")
    return int(any(not o.equal or o.slow for o in found))


if __name__ == "__main__":
    sys.exit(main())
