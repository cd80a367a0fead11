"""``python -m hornspark.cli LAYER FILE...``: lex, token, parse, relational, interpret, optimize, canonical."""

from __future__ import annotations

import argparse
import logging
import sys

from hornspark.plans.lexer import token_report, tokenize
from hornspark.plans.parser import DatalogSyntaxError, parse_report
from hornspark.sources.program import read_program, read_text


def session():
    from pyspark.sql import SparkSession

    builder = SparkSession.builder.appName("hornspark").config("spark.ui.showConsoleProgress", "false")
    return builder.config("spark.sql.shuffle.partitions", "8").getOrCreate()


def main(argv: list[str] | None = None) -> int:
    arg = argparse.ArgumentParser(prog="hornspark", description=__doc__)
    arg.add_argument("layer", choices=["lex", "token", "parse", "relational", "interpret", "optimize", "canonical"])
    arg.add_argument("inputs", nargs="+", help="program files, merged in order; for token, the strings themselves")
    arg.add_argument("-d", "--debug", default=logging.ERROR, type=int, metavar="LEVEL", help="logging level")
    arg.add_argument("-p", "--part", default=2, type=int, help="of parse: 1 only says whether the program parses, 2 also prints it, or the offending token")
    arg.add_argument("--fast", action="store_true", help="evaluate all rules of a round at once; pass counts then differ")
    args = arg.parse_args(argv)
    logging.basicConfig(level=args.debug)
    if args.layer == "token":
        for text in args.inputs:
            print(tokenize(text, keep_comments=True, keep_whitespace=True)[0])
        return 0
    if args.layer == "lex":
        print("\n".join(token_report(read_text(f)) for f in args.inputs))
        return 0
    if args.layer == "parse" and len(args.inputs) == 1:
        out = parse_report(read_text(args.inputs[0]))
        print(out if args.part == 2 else out.partition("\n")[0])
        return int(out.startswith("Failure!"))
    try:
        program = read_program(*args.inputs)
    except DatalogSyntaxError as e:
        print("Failure!" if args.layer == "parse" and args.part != 2 else f"Failure!\n  {e.token}")
        return 1
    if args.layer == "parse":
        print(f"Success!\n{program}" if args.part == 2 else "Success!")
        return 0
    if args.layer == "canonical":
        print(program.canonical())
        return 0
    from hornspark import report
    from hornspark.engine import Engine

    spark = session()
    evaluation, render = {
        "relational": ("relational", report.relational_report),
        "interpret": ("interpreter", report.interpreter_report),
        "optimize": ("optimized", report.optimizer_report),
    }[args.layer]
    print(render(Engine(spark).run(program, evaluation=evaluation, mode="fast" if args.fast else "compat")), end="")
    return 0


if __name__ == "__main__":
    sys.exit(main())
