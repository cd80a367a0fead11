"""Personal data by candidate generation and gradient boosting, in DataFrame operations only.

Base spans are the matches of four patterns that pass a check (an ip's parts at most 255, a card's digits in
number and by Luhn, a phone's digits in number). Further generators with a high recall propose overlapping candidates: spelled-out, decorated and
international forms. Boosted regression trees judge a candidate by its format and its context; they are fitted in this process on labelled examples
drawn here, and each kind's threshold is the least calibrated probability at which candidates held out from the fit have a precision of PRECISION.
The trees become one SQL expression. Base spans always stay; a selected candidate is added unless it lies within a base span of its kind.

Everything is computed in a text's own row: matches come from the pattern's matches and the pieces between them, positions from their lengths in code
points, in time that grows with the text's length and, but for a logarithm, with the number of matches. So no text is shuffled, no Python runs on executors, and no group of rows can be large. The patterns are possessive, so
the engine neither backtracks nor recurses over long texts.

Null counts as empty; an empty text has no spans, and the digest of the empty string. Texts are read whole. Repeated rows give repeated results.
"""

from __future__ import annotations

import json
import random
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LOCAL, LABEL = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"
# Base patterns. A match begins at the start of a run or where the last match ended, which is where the plain
# pattern would find it, too.
BASE = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{LABEL}++(?:\.{LABEL}++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind's patterns to be tried at all: none of their matches goes without it.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
AT, DOT = r"(?:\[at\]|\(at\)|\{at\}|\x20at\x20)", r"(?:\.|\[dot\]|\(dot\)|\{dot\}|\x20dot\x20)"
#: Generators: kind, what a text must hold, pattern.
GENERATORS = (
    ("email", "@", r"(?:\G|(?<![\p{L}\p{N}._%+-]))[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)*+"),
    ("email", r"(?i)[\[({\x20]dot[\])}\x20]|[\[({]at[\])}]|\x20at\x20\x20?[A-Za-z0-9-]++\x20?\.\x20?[A-Za-z0-9-]", rf"(?i)(?<!{LOCAL}){LOCAL}++\x20?{AT}\x20?{LABEL}++(?:\x20?{DOT}\x20?{LABEL}++)++"),
    ("ip", r"[0-9A-Fa-f]:[0-9A-Fa-f:]|::", r"(?<![\p{L}\p{N}:.])(?:[0-9A-Fa-f]{0,4}+:){2,7}+[0-9A-Fa-f]{0,4}+(?![\p{L}\p{N}:])"),
    ("ip", r"[0-9](?:\[\.\]|\(\.\)|\[dot\])[0-9]", r"(?<![0-9])[0-9]{1,3}+(?:(?:\[\.\]|\(\.\)|\[dot\]|\.)[0-9]{1,3}+){3}+"),
    ("card", r"[0-9][\x20._/-]{0,2}[0-9][\x20._/-]{0,2}[0-9][\x20._/-]{0,2}[0-9]", r"(?<![0-9])[0-9](?:[\x20._/-]{0,2}[0-9]){11,22}+(?![0-9])"),
    ("phone", r"[0-9]{2}", r"(?<![\p{L}\p{N}.])(?:\+|00)?+\(?[0-9]{1,4}+\)?(?:[\x20./-]{0,2}\(?[0-9]{2,5}+\)?){1,5}+(?![\p{L}\p{N}])"),
)
# Words before a candidate that speak for a kind, and for none.
CONTEXT = {
    "email": r"e-?mail|mail|contact|reach|write|address|@",
    "ip": r"\bip|ipv[46]|server|host|address|login|from|gateway|dns",
    "card": r"card|visa|master|amex|credit|debit|payment|pay|account",
    "phone": r"phone|tel|call|mobile|cell|fax|dial|whatsapp|sms|number|ring",
}
AGAINST = r"version|isbn|issn|order|invoice|item|part|serial|build|page|section|chapter|date|year|score|ratio|time|price|total|sum|row|ticket|tracking|id"
BEFORE, AFTER = 32, 2
PRECISION = 0.98
#: Code points to a piece of a text that is redacted.
PIECE = 1024
ENTRY = "array<struct<kind:int,s:int,e:int,v:string,l:string,r:string>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` computed once: inside a lambda function an expression is computed anew for each element, a variable isn't."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _scan(values: Column, join: Callable[[Column, Column], Column], zero: Column) -> Column:
    """Running totals (or maxima) of an array: after the step of distance d each element covers the 2 * d elements up to itself. ``values`` is a variable."""
    steps = F.filter(F.array(*(F.lit(1 << k) for k in range(31))), lambda d: d < F.size(values))
    return F.aggregate(steps, values, lambda acc, d: F.transform(acc, lambda x, i: join(x, F.coalesce(F.get(acc, i - d), zero))))


def _matches(text: Column, needs: str, pattern: str, kind: int, context: bool = False) -> Column:
    """Located matches in text order: kind, start, end, the text matched, and with ``context`` what stands before and after."""
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g"))
    ends = lambda p: _let(F.transform(p, lambda z: F.length(z["g"]) + F.coalesce(F.length(z["m"]), F.lit(0))), lambda n: _scan(n, lambda a, b: a + b, F.lit(0)))

    def entries(p: Column) -> Column:
        def entry(z: Column, i: Column) -> Column:
            m, before, after = z["p"]["m"], F.get(p, i - 1), F.get(p, i + 1)
            left = F.right(F.concat(F.coalesce(F.right(before["m"], F.lit(BEFORE)), F.lit("")), z["p"]["g"]), F.lit(BEFORE)) if context else F.lit("")
            # No match is shorter than two characters.
            right = F.left(F.concat(F.left(after["g"], F.lit(AFTER)), F.coalesce(F.left(after["m"], F.lit(AFTER)), F.lit(""))), F.lit(AFTER)) if context else F.lit("")
            return F.struct(F.lit(kind).alias("kind"), (z["e"] - F.length(m)).alias("s"), z["e"].alias("e"), m.alias("v"), left.alias("l"), right.alias("r"))

        return F.transform(F.slice(F.arrays_zip(p.alias("p"), ends(p).alias("e")), F.lit(1), F.size(p) - 1), entry)  # the last piece ends the text

    return F.when(text.rlike(needs), _let(pairs, entries).cast(ENTRY)).otherwise(F.array().cast(ENTRY))


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, r"[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """The check sum of a string of digits holds."""

    def add(total: Column, z: Column) -> Column:
        d = z.cast("int")
        return F.struct((total["sum"] + F.when(total["odd"], F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)).alias("sum"), (~total["odd"]).alias("odd"))

    zero = F.struct(F.lit(0).alias("sum"), F.lit(False).alias("odd"))
    return F.aggregate(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), zero, add, lambda t: t["sum"] % 10 == 0)


def _card_ok(v: Column) -> Column:
    digits = _digits(v)
    return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)


VALID: dict[str, Callable[[Column], Column]] = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.forall(F.split(v, r"\."), lambda p: F.coalesce(p.try_cast("bigint") <= 255, F.lit(False))),
    "card": _card_ok,
    "phone": lambda v: F.length(_digits(v)).between(9, 15),
}


def _base(text: Column) -> Column:
    def checked(i: int, kind: str) -> Column:
        return F.filter(_matches(text, NEEDS[kind], BASE[kind], i), lambda x: VALID[kind](x["v"]))

    return F.concat(*(checked(i, k) for i, k in enumerate(KINDS)))


def _candidates(text: Column) -> Column:
    return F.concat(*(_matches(text, needs, pattern, KINDS.index(kind), context=True) for kind, needs, pattern in GENERATORS))


# --- features ----------------------------------------------------------------------------------------------


def _features(x: Column) -> dict[str, Column]:
    v, left, right = x["v"], F.lower(x["l"]), x["r"]
    digits = _digits(v)
    groups = F.filter(F.split(v, r"[^0-9]++"), lambda g: g != "")
    sizes = F.transform(groups, lambda g: F.length(g))
    as_int = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    own = F.element_at(F.array(*(as_int(left.rlike(CONTEXT[k])) for k in KINDS)), x["kind"] + 1)
    return {
        "kind": x["kind"],
        "length": F.length(v),
        "digits": F.length(digits),
        "groups": F.size(groups),
        "longest": F.coalesce(F.array_max(sizes), F.lit(0)),
        "shortest": F.coalesce(F.array_min(sizes), F.lit(0)),
        "luhn": as_int(F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)),
        "plus": as_int(v.startswith("+")),
        "parens": as_int(v.contains("(")),
        "seps": F.length(F.regexp_replace(v, r"[\p{L}\p{N}]", "")),
        "kinds_of_seps": F.size(F.array_distinct(F.split(F.regexp_replace(v, r"[\p{L}\p{N}]", ""), ""))),
        "colons": F.length(F.regexp_replace(v, "[^:]", "")),
        "hex": F.length(F.regexp_replace(v, "[^A-Fa-f]", "")),
        "letters": F.length(F.regexp_replace(v, r"[^\p{L}]", "")),
        "last_label": F.length(F.element_at(F.split(v, r"[^\p{L}\p{N}]++"), -1)),
        "dot_after_at": as_int(v.rlike(r"(?i)(?:@|at[\])}\x20])[^@]*(?:\.|dot)[^@]*\p{L}{2,}$")),
        "date": as_int(v.rlike(r"^(?:[0-9]{4}[-./][0-9]{1,2}[-./][0-9]{1,2}|[0-9]{1,2}[-./][0-9]{1,2}[-./][0-9]{2,4})")),
        "four_parts": as_int(v.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$")),
        "zero": as_int(v.rlike(r"^(?:0[1-9]|\(0)")),
        "for": own,
        "against": as_int(left.rlike(rf"(?:{AGAINST})\W*+(?:\p{{L}}++\W++)?$")),
        "glued": as_int(left.rlike(r"[\p{L}\p{N}/=#_$€£.-]$")),
        "goes_on": as_int(right.rlike(r"^[\p{L}\p{N}%/=_]|^[.,][0-9]")),
    }


NAMES = ("kind", "length", "digits", "groups", "longest", "shortest", "luhn", "plus", "parens", "seps", "kinds_of_seps", "colons", "hex", "letters", "last_label", "dot_after_at", "date", "four_parts", "zero", "for", "against", "glued", "goes_on")


# --- labelled examples -----------------------------------------------------------------------------------------


def _luhn_number(rng: random.Random, n: int, valid: bool) -> str:
    d = [rng.randint(1, 9)] + [rng.randint(0, 9) for _ in range(n - 2)]
    for check in range(10):
        total = sum(x if i % 2 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d)))
        if (total + check) % 10 == 0:
            break
    return "".join(map(str, d)) + str(check if valid else (check + rng.randint(1, 9)) % 10)


def _example(rng: random.Random) -> tuple[str, int, str]:
    """A text, a kind's number and the value in it that is personal data of that kind; or -1 and "" if there is none."""

    def word(lo: int = 2, hi: int = 9) -> str:
        return "".join(rng.choice("abcdefghilmnoprstuv") for _ in range(rng.randint(lo, hi)))

    def num(n: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(n))

    sep = rng.choice([" ", "-", ".", " ", "-"])
    cue = rng.random() < 0.5
    kind = rng.randrange(11)
    if kind == 0:
        name, host = rng.choice([word(), f"{word()}.{word()}", f"{word()}{num(2)}"]), f"{word()}.{rng.choice(['com', 'org', 'net', 'de', 'fr'])}"
        at, dot = rng.choice([(" [at] ", " [dot] "), ("(at)", "(dot)"), (" at ", " dot "), ("[at]", "."), ("{at}", "{dot}"), (" at ", "."), ("@", ".")])
        name = name + rng.choice(["é", "ü", ""]) if at == "@" else name
        value, label, before = name + at + host.replace(".", dot), 0, "mail me at" if at != " at " else "email"
        if at == "@":
            name += "é"
            value = name + at + host
    elif kind in (1, 8):
        value, label, before = ":".join(f"{rng.randrange(65536):x}" for _ in range(8)), 1, "server ip"
        if rng.random() < 0.4:
            value = f"{rng.randrange(4096, 65536):x}:{rng.randrange(65536):x}::{rng.randrange(65536):x}"
        if rng.random() < 0.4:
            value = "[.]".join(str(rng.randrange(256)) for _ in range(4))
    elif kind == 2:
        n, raw = 16, _luhn_number(rng, 16, True)
        s = rng.choice([".", "  ", "/", "_", " - "[1:]])
        value, label, before = s.join(raw[i : i + 4] for i in range(0, n, 4)), 2, "card number"
    elif kind in (3, 4):
        value = rng.choice([f"({num(3)}) 555{sep}{num(4)}", f"{rng.randint(2, 9)}{num(2)}{sep}{num(3)}{sep}{num(4)}", f"0{num(3)}{sep}{num(3)}{sep}{num(4)}", f"0{num(2)} {num(2)} {num(2)} {num(2)} {num(2)}"[1:], f"00{rng.randint(30, 49)} {num(3)} {num(3)} {num(4)}"])
        label, before = 3, rng.choice(["call", "phone:", "tel", "mobile number", "fax"])
        cue = cue or rng.random() < 0.7
    elif kind == 9:  # base forms, which other kinds' generators meet as well
        label = rng.randrange(4)
        value = [f"{word()}.{num(2)}@{word()}.com", ".".join(str(rng.randrange(256)) for _ in range(4)), _luhn_number(rng, 16, True), f"+1 ({num(3)}) {num(3)}-{num(4)}"][label]
        before = rng.choice(["from", "at", "to", "call", "ip"])
    else:
        label, before = -1, rng.choice(["order", "version", "invoice", "isbn", "build", "date", "score", "item", "total", "page"])
        value = rng.choice([
            f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}", f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.{rng.randint(1990, 2030)}", f"{num(2)}:{num(2)}:{num(2)}", f"{num(2)}:{num(2)}",
            _luhn_number(rng, rng.choice([12, 13, 15, 16, 16, 16, 18]), False), _luhn_number(rng, 16, False), num(rng.randint(4, 11)), f"{num(3)} {num(3)}", f"{num(4)} {num(4)} {num(2)}", f"{rng.randint(1, 9)}.{num(1)}.{num(2)}", f"978-{num(1)}-{num(4)}-{num(4)}-{num(1)}",
            f"{num(2)}.{num(2)}", f"{rng.randint(1, 99)},{num(3)},{num(3)}", f"{word()} at {word()}", f"{word()} at {word()}. {word().capitalize()}", f"{word()} at {word()}. {word().capitalize()}", f"{word()}@{word()}", f"{num(3)}-{num(2)}", f"1990-{num(4)}", f"{num(5)} {num(5)}", f"{word(1, 3)}::{word(1, 3)}", "".join(rng.choice("0123456789abcdef") for _ in range(40)), f"{num(2)} {num(2)} {num(2)}", f"v{num(1)}.{num(1)}.{num(1)}.{num(1)}",
            f"{num(4)}-{num(4)}-{num(4)}-{num(4)}", f"{num(1)}/{num(2)}/{num(4)}",
        ])
        if rng.random() < 0.1:
            before = rng.choice(["call", "card number", "phone", "email", "ip"])
    lead = " ".join(word() for _ in range(rng.randint(0, 6)))
    text = f"{lead} {before + ' ' if cue else ''}{value}{rng.choice(['', '.', ',', ' ' + word(), ' ' + word() + ' ' + word()])}".strip()
    return text, label, value if label >= 0 else ""


# --- boosting --------------------------------------------------------------------------------------------------


class Boosted:
    """Logistic gradient boosting with trees of a fixed depth, and its form as an SQL expression."""

    def __init__(self, depth: int = 3, rounds: int = 40, rate: float = 0.25):
        self.depth, self.rounds, self.rate = depth, rounds, rate
        self.trees: list = []
        self.bias = self.slope = self.shift = 0.0
        self.thresholds = [2.0] * len(KINDS)

    def _grow(self, x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int):
        leaf = float(self.rate * grad.sum() / (hess.sum() + 1.0))
        if not depth or len(x) < 20:
            return leaf
        base, best = grad.sum() ** 2 / (hess.sum() + 1.0), (1e-3, None, None)
        for f in range(x.shape[1]):
            for cut in np.unique(np.quantile(x[:, f], np.linspace(0.05, 0.95, 16))):
                left = x[:, f] <= cut
                if 5 <= left.sum() <= len(x) - 5:
                    g, h = grad[left].sum(), hess[left].sum()
                    gain = g**2 / (h + 1.0) + (grad.sum() - g) ** 2 / (hess.sum() - h + 1.0) - base
                    if gain > best[0]:
                        best = (gain, f, float(cut))
        if best[1] is None:
            return leaf
        left = x[:, best[1]] <= best[2]
        return best[1], best[2], self._grow(x[left], grad[left], hess[left], depth - 1), self._grow(x[~left], grad[~left], hess[~left], depth - 1)

    def _value(self, tree, x: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        f, cut, a, b = tree
        return np.where(x[:, f] <= cut, self._value(a, x), self._value(b, x))

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.bias + sum(self._value(t, x) for t in self.trees)

    def fit(self, x: np.ndarray, y: np.ndarray, rest: np.ndarray) -> Boosted:
        """Trees from the rows not in ``rest``; scale and thresholds from those in it."""
        a, b = x[~rest], y[~rest]
        share = min(0.99, max(0.01, b.mean()))
        self.bias = float(np.log(share / (1 - share)))
        total = np.full(len(a), self.bias)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-total))
            self.trees.append(self._grow(a, b - p, p * (1 - p), self.depth))
            total += self._value(self.trees[-1], a)
        m, t = self.margin(x[rest]), y[rest]
        self.slope, self.shift = 1.0, 0.0
        for _ in range(200):  # Platt scaling
            p = 1 / (1 + np.exp(-np.clip(self.slope * m + self.shift, -30, 30)))
            self.slope += 0.5 * float(((t - p) * m).mean() - 1e-3 * (self.slope - 1))
            self.shift += 0.5 * float((t - p).mean())
        p = 1 / (1 + np.exp(-np.clip(self.slope * m + self.shift, -30, 30)))
        for k in range(len(KINDS)):
            mine = x[rest][:, 0] == k
            for cut in np.unique(np.round(p[mine], 3)):
                chosen = mine & (p >= cut)
                if cut >= 0.5 and t[chosen].mean() >= PRECISION:
                    self.thresholds[k] = float(cut)
                    break
        return self

    def _case(self, tree, names: list[str]) -> str:
        if not isinstance(tree, tuple):
            return f"{tree:.9f}D"
        f, cut, a, b = tree
        return f"IF({names[f]} <= {cut:.6f}D, {self._case(a, names)}, {self._case(b, names)})"

    def probability_sql(self, names: list[str]) -> str:
        total = " + ".join([f"({self.bias:.9f}D)", *(self._case(t, names) for t in self.trees)])
        return f"1D / (1D + exp(-({self.slope:.9f}D * ({total}) + ({self.shift:.9f}D))))"


_fitted: list[Boosted] = []


def fitted(spark: SparkSession, examples: int = 4000, seed: int = 5) -> Boosted:
    """The model, once per process: examples go through the same expressions as documents do, and a few thousand rows of features come back."""
    if not _fitted:
        rng = random.Random(seed)
        rows = [dict(zip(("id", "text", "kind", "value"), (i, *_example(rng)), strict=True)) for i in range(examples)]
        one = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), "array<struct<id:int,text:string,kind:int,value:string>>")).alias("x")).select("x.*")
        found = one.select("id", F.col("kind").alias("true_kind"), "value", F.explode(_candidates(F.col("text"))).alias("c"))
        values = _features(F.col("c"))
        label = ((F.col("c.kind") == F.col("true_kind")) & (F.col("c.v") == F.col("value"))).cast("int")
        table = found.select("id", label.alias("label"), *(values[n].cast("double").alias(n) for n in NAMES)).orderBy("id", *NAMES).collect()
        x = np.array([[r[n] for n in NAMES] for r in table])
        # All candidates of an example are on one side.
        _fitted.append(Boosted().fit(x, np.array([r["label"] for r in table], float), np.array([r["id"] % 3 == 0 for r in table])))
    return _fitted[0]


# --- spans -----------------------------------------------------------------------------------------------------


def _listed(spans: Column) -> Column:
    """kind:start:end by start, then kind, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["kind"].alias("kind"), x["e"].alias("e"))))
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def free_name(docs: DataFrame, wanted: str) -> str:
    """``wanted``, lengthened until no column of ``docs`` has that name."""
    taken = {c.lower() for c in docs.columns}
    while wanted in taken:
        wanted += "_"
    return wanted


def with_spans(docs: DataFrame, base: str = "base", spans: str = "spans") -> DataFrame:
    """``docs`` and two columns, named as given: base spans and all spans, arrays of (kind, s, e)."""
    model = fitted(docs.sparkSession)
    text, work = F.coalesce(F.col("text"), F.lit("")), free_name(docs, "found")
    brief = lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"))
    some = docs.withColumn(base, F.transform(_base(text), brief)).withColumn(work, _candidates(text))
    judged = F.transform(F.col(work), lambda x: F.struct(brief(x).alias("span"), F.struct(*(c.cast("double").alias(n) for n, c in _features(x).items())).alias("f")))
    some = some.withColumn(work, F.when(F.size(work) > 0, judged))
    cuts = ", ".join(f"{t:.6f}D" for t in model.thresholds)
    chosen = f"transform(filter(coalesce({work}, array()), c -> {model.probability_sql([f'c.f.{n}' for n in NAMES])} >= element_at(array({cuts}), c.span.kind + 1)), c -> c.span)"
    added = lambda c: F.when(F.size(c) > 0, _outside(F.col(base), c)).otherwise(c)
    return some.withColumn(spans, F.concat(F.col(base), _let(F.expr(chosen), added))).drop(work)


def _outside(base: Column, chosen: Column) -> Column:
    """The different spans of ``chosen`` that lie in no base span of their kind: by order, each meets the farthest end of the base spans before it."""
    item = lambda x, rank: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), F.lit(rank).alias("rank"), x["e"].alias("e"))
    both = F.array_sort(F.concat(F.transform(base, lambda x: item(x, 0)), F.transform(chosen, lambda x: item(x, 1))))
    far = lambda x: x["kind"] * F.lit(1 << 40) + x["e"]

    def kept(z: Column) -> Column:
        ends = _let(F.transform(z, lambda x: F.when(x["rank"] == 0, far(x)).otherwise(F.lit(-1))), lambda n: _scan(n, F.greatest, F.lit(-1)))
        new = F.filter(F.arrays_zip(z.alias("x"), ends.alias("far")), lambda y, i: (y["x"]["rank"] == 1) & (y["far"] < far(y["x"])) & ~y["x"].eqNullSafe(F.get(z, i - 1)))
        return F.transform(new, lambda y: F.struct(y["x"]["kind"].alias("kind"), y["x"]["s"].alias("s"), y["x"]["e"].alias("e")))

    return _let(both, kept)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans."""
    some = with_spans(docs.select("doc_id", "text"))

    def count(i: int) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == i)).cast("long")

    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return some.select("doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with every maximal stretch of overlapping spans replaced by its first span's kind in brackets.

    The text is dealt into pieces of PIECE code points first, as a part of a long text is found by counting from its start.
    """
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["kind"].alias("kind"), x["e"].alias("e"))))

    def joined(z: Column, ends: Column, pieces: Column) -> Column:
        def part(a: Column, b: Column) -> Column:
            first = (a / PIECE).cast("int")
            return F.substring(F.array_join(F.slice(pieces, first + 1, (b / PIECE).cast("int") - first + 1), ""), a % PIECE + 1, b - a)

        def shown(x: Column, i: Column) -> Column:
            before = F.coalesce(F.get(ends, i - 1), F.lit(0))
            return F.when(x["s"] >= before, F.concat(part(before, x["s"]), F.element_at(names, x["kind"] + 1))).otherwise("")

        last = F.element_at(ends, -1)
        return F.concat(F.array_join(F.transform(z, shown), ""), part(last, F.length(text)))

    return _let(ordered, lambda z: _let(_let(F.transform(z, lambda x: x["e"]), lambda e: _scan(e, F.greatest, F.lit(0))), lambda ends: _let(F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0)), lambda pieces: joined(z, ends, pieces))))


def redact(docs: DataFrame) -> DataFrame:
    """The pipeline's stage: all rows, with the spans of ``text`` replaced and n_chars, where there is one, brought up to date."""
    base, spans = free_name(docs, "base"), free_name(docs, "spans")
    some = with_spans(docs, base, spans)
    has = F.size(spans) > 0
    text = F.when(has, redacted(F.col("text"), F.col(spans))).otherwise(F.col("text"))
    out = some.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(has, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def redact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)
