"""The sandbox, the comparison with other implementations, command-line options."""

import sys

from hornspark.cli import main
from hornspark.compare import LAYERS, TRIAL, compare, detect, ours
from hornspark.sandbox import Sandbox
from hornspark.sandbox import main as sandbox

GOOD = "Schemes: p(a) Facts: p('1'). Rules: q(X) :- p(X). Queries: q(X)? # done"


def python(code):
    return [sys.executable, "-c", code]


def test_sandbox(spark, tmp_path):
    box = Sandbox(spark)
    panes = box.update(GOOD)
    assert list(panes) == ["tokens", "parse", "relational", "interpreter", "optimizer"]
    assert "COMMENT" in panes["tokens"] and panes["relational"].startswith("q(X)? No") and "q(X)? Yes(1)" in panes["interpreter"]
    assert box.command("pause") and box.update("Schemes:") is panes
    assert box.command("pause") and box.command("comments") and "COMMENT" not in box.update(GOOD)["tokens"]
    assert box.command("whitespace") and "WHITESPACE" in box.update(GOOD)["tokens"]
    assert box.command(f"save {tmp_path / 'saved'}") and "q(X)?" in (tmp_path / "saved").read_text()
    assert list(box.update("Schemes:")) == ["tokens", "parse"] and box.panes["parse"].startswith("Failure!")
    assert not box.command("quit")


def test_sandbox_with_others(spark, tmp_path, capsys):
    others = {"lex": python("import time; time.sleep(9)"), "parse": python("print('Success!')"), "relational": python("import os; os.abort()")}
    panes = Sandbox(spark, layers=("lex", "parse", "relational"), others=others, timeout=1.5).update(GOOD)
    assert panes["tokens (other)"].startswith("[timeout]") and panes["parse (other)"] == "Success!\n" and panes["relational (other)"].startswith("[crashed]")
    f = tmp_path / "p.txt"
    f.write_text(GOOD)
    sandbox([str(f), "--once", "--ignore-comments", "--layers", "lex", "parse"])
    out = capsys.readouterr().out
    assert "== tokens ==" in out and "COMMENT" not in out and "== relational ==" not in out


def test_every_layer_is_told_by_its_report(spark, tmp_path):
    for layer in LAYERS:
        f = tmp_path / layer
        f.write_text(ours(layer, TRIAL))
        assert detect(python(f"print(open({str(f)!r}).read())")) == layer


def test_compare(spark, tmp_path):
    f, g = tmp_path / "p.txt", tmp_path / "q.txt"
    f.write_text(GOOD)
    g.write_text("Schemes: (")
    own = python("import sys; from hornspark.cli import main; sys.exit(main(['parse', sys.argv[1]]))")
    assert [o.status for o in compare(own, [str(f), str(g)])] == ["equal", "equal"]
    assert [o.status for o in compare(python("print('q(X)? Yes(2)')"), [str(f)], "interpret")] == ["different"]
    assert [o.status for o in compare(python("import sys; sys.exit(3)"), [str(f), str(f)], "lex")] == ["crashed", "crashed"]
    assert [o.status for o in compare(python("import time; time.sleep(9)"), [str(f)], "lex", timeout=0.5)] == ["timeout"]
    assert [o.status for o in compare(["/no/such/program"], [str(f)], "lex")] == ["crashed"]
    assert compare(own, [str(f)], "parse", bound=1e-9)[0].slow and not compare(own, [str(f)], "parse", bound=1e9)[0].slow


def test_parse_parts(tmp_path, capsys):
    good, bad = tmp_path / "good", tmp_path / "bad"
    good.write_text(GOOD)
    bad.write_text("Schemes: (")
    for args, code, lines in (([str(good)], 0, 11), (["-p", "1", str(good)], 0, 1), (["-p", "1", str(bad)], 1, 1), ([str(bad)], 1, 2), (["-p", "1", str(good), str(good)], 0, 1)):
        assert main(["parse", *args]) == code
        assert len(capsys.readouterr().out.strip().splitlines()) == lines
