"""Personal data by candidate gradient boosting, in DataFrame functions only.

The base kinds are regular expressions with a check each; their spans always stay. High-recall generators propose further
spans that may overlap: obfuscated addresses, cards inside longer numbers or with other separators, telephone numbers
without +, addresses with bracketed dots. Boosted trees score each proposal on features of its format and of its context, and a
threshold a kind, calibrated on examples that the trees have not seen, selects the redactions.

The trees are fitted on examples that examples() makes from a fixed seed: personal data in many formats, and numbers that
are none, among invented words. They become one CASE expression, so scoring stays inside the JVM.
"""

from __future__ import annotations

import functools
import json
import random
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ["email", "ip", "card", "phone"]
LOCAL = "A-Za-z0-9._%+-"
#: The base patterns, written so that Java's matcher is linear: a match begins at the start of a run or where the last one ended.
BASE = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Proposals; each name begins with its kind.
GENERATORS = {
    "email_words": rf"(?<![{LOCAL}])[{LOCAL}]{{1,64}}+\x20?(?:\(at\)|\[at\]|\{{at\}}|\x20at\x20)\x20?[A-Za-z0-9-]{{1,63}}+(?:(?:\.|\x20?(?:\(dot\)|\[dot\]|\{{dot\}})\x20?|\x20dot\x20)[A-Za-z0-9-]{{1,63}}+){{1,8}}+",
    "ip_brackets": r"(?<![0-9.])[0-9]{1,3}+(?:\x20?(?:\[\.\]|\(\.\)|\[dot\]|\(dot\))\x20?[0-9]{1,3}+){3}(?![0-9])",
    "card_inside": r"(?<![0-9.])[0-9]{12,19}+(?![0-9.])",
    "card_groups": r"(?<![0-9.])[0-9]{4}(?:[\x20._/-]{1,2}[0-9]{4}){2}[\x20._/-]{1,2}[0-9]{1,7}(?![0-9])",
    "phone_plain": r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])",
    "phone_zeros": r"(?<![0-9+.])00[1-9][0-9]{0,2}[\x20.()-]{1,2}[0-9][\x20()0-9.-]{5,20}[0-9](?![0-9])",
}
#: What a text must hold before a pattern is tried.
GUARDS = {
    "email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]",
    "email_words": r"\(at\)|\[at\]|\{at\}|\x20at\x20", "ip_brackets": r"[0-9]\x20?[\[(](?:\.|dot)", "card_inside": r"[0-9]{12}",
    "card_groups": r"[0-9]{4}[\x20._/-]{1,2}[0-9]{4}", "phone_plain": r"[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}", "phone_zeros": r"00[1-9]",
}
KEYWORDS = {"email": r"(?i)e-?mail|write|contact|reach", "ip": r"(?i)\bip\b|host|server|addr|login", "card": r"(?i)card|visa|pay|credit|account", "phone": r"(?i)phone|tel|call|fax|mobile|cell|dial"}
FEATURES = ["kind", "n_digits", "length", "n_separators", "n_separator_kinds", "luhn", "first_digit", "distinct_digits", "keyword", "counter", "before", "after", "octets", "bracketed", "spelt", "last_label", "grouped"]
FOUND = "array<struct<s:int,e:int,m:string,b:string,a:string>>"
TREES, RATE, PRECISION = 40, 0.3, 0.98


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.when((n > 0) & (n < 40), F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), add) % 10 == 0).otherwise(False)


def _octets(m: Column, parts: str) -> Column:
    """Whether all numbers are at most 255, leading zeros aside."""
    bare = lambda x: F.regexp_replace(x, "^0+(?=[0-9])", "")
    return F.forall(F.regexp_extract_all(m, F.lit(parts), F.lit(0)), lambda x: (F.length(bare(x)) < 3) | ((F.length(bare(x)) == 3) & (bare(x) <= "255")))


VALID: dict[str, Callable[[Column], Column]] = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: _octets(m, "[0-9]+"),
    "card": lambda m: F.length(_digits(m)).between(12, 19) & _luhn(_digits(m)),
    "phone": lambda m: F.length(_digits(m)).between(9, 15),
}


def _with_matches(df: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """Adds for each name the matches of its pattern with their places (code points, end exclusive) and what stands around them.

    The pieces between matches are the same pattern's split; running lengths give the places.
    """
    df = df.withColumns({f"m_{k}": F.when(F.col("t").rlike(GUARDS[k]), F.regexp_extract_all("t", F.lit(p), F.lit(0))) for k, p in patterns.items()})
    df = df.withColumns({f"g_{k}": F.when(F.size(f"m_{k}") > 0, F.split("t", p, -1)) for k, p in patterns.items()})

    def places(k: str) -> Column:
        whole = F.transform(f"m_{k}", lambda m, i: F.struct(m.alias("m"), F.get(f"g_{k}", i).alias("b"), F.get(f"g_{k}", i + 1).alias("a")))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(FOUND).alias("out"))

        def step(acc: Column, x: Column) -> Column:
            s = acc["at"] + F.length(x["b"])
            e = s + F.length(x["m"])
            one = F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m"), F.right(x["b"], F.lit(24)).alias("b"), F.left(x["a"], F.lit(2)).alias("a"))
            return F.struct(e.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

        return F.when(F.size(f"m_{k}") > 0, F.aggregate(whole, start, step, lambda acc: acc["out"])).otherwise(F.array().cast(FOUND))

    df = df.withColumns({f"x_{k}": places(k) for k in patterns})
    return df.drop(*[f"{c}_{k}" for k in patterns for c in "mg"])


def _side(c: Column) -> Column:
    """0: nothing or a blank, 1: a letter, 2: a digit, 3: another sign."""
    return F.when(F.length(c) == 0, 0).when(c.rlike(r"[\x20\x09-\x0D]"), 0).when(c.rlike("[0-9]"), 2).when(c.rlike(r"\p{L}"), 1).otherwise(3)


def _features(kind: str, x: Column) -> Column:
    m, d = x["m"], _digits(x["m"])
    separators = F.regexp_replace(m, r"[\p{L}0-9]", "")
    any_word = "|".join(v.removeprefix("(?i)") for k, v in KEYWORDS.items() if k != kind)
    values = {
        "kind": F.lit(KINDS.index(kind)), "n_digits": F.length(d), "length": F.length(m), "n_separators": F.length(separators),
        "n_separator_kinds": F.size(F.array_distinct(F.split(separators, ""))), "luhn": _luhn(d).cast("int"), "first_digit": F.coalesce(F.try_to_number(F.left(d, F.lit(1)), F.lit("9")).cast("int"), F.lit(-1)),
        "distinct_digits": F.size(F.array_distinct(F.split(d, ""))), "keyword": x["b"].rlike(KEYWORDS[kind]).cast("int"), "counter": x["b"].rlike(f"(?i){any_word}|order|invoice|no\\.|number|version|serial|isbn").cast("int"),
        "before": _side(F.right(x["b"], F.lit(1))), "after": _side(F.left(x["a"], F.lit(1))), "octets": _octets(m, "[0-9]+").cast("int"),
        "bracketed": m.rlike(r"[\[({](?:at|dot|\.)[\])}]").cast("int"), "spelt": m.rlike(r"[\x20\[({]dot[\x20\])}]").cast("int"), "last_label": F.length(F.regexp_extract(m, r"([A-Za-z]*)$", 1)), "grouped": m.rlike(r"^[0-9]{4}(.)[0-9]{4}\1[0-9]{4}\1[0-9]{1,4}$").cast("int"),
    }
    return F.struct(x["s"].alias("s"), x["e"].alias("e"), *[values[f].cast("double").alias(f) for f in FEATURES])


def _proposals(df: DataFrame) -> DataFrame:
    """Adds c: the proposals of all generators with their features."""
    df = _with_matches(df, GENERATORS)
    found = [F.transform(f"x_{g}", functools.partial(lambda kind, x: _features(kind, x), g.split("_")[0])) for g in GENERATORS]
    return df.withColumn("c", F.concat(*found)).drop(*[f"x_{g}" for g in GENERATORS])


# Fitting.


def examples(n: int = 1500, seed: int = 11) -> list[tuple[int, str, list[tuple[int, int]]]]:
    """(id, text, places of personal data) of invented texts."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["an", "re", "to", "li", "sche", "ou", "mente", "er", "ka", "do"]) for _ in range(r.randint(1, 4)))
    digits = lambda k: "".join(str(r.randint(0, 9)) for _ in range(k))

    def card(k: int = 16) -> str:
        body = r.choice("3456") + digits(k - 2)
        total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(body))))
        return body + str(-total % 10)

    def email() -> str:
        at, dot = r.choice([("(at)", "(dot)"), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" at ", " dot "), ("{at}", "."), ("[at]", ".")])
        return f"{word()}{r.choice(['', '.', '_'])}{word()}{at}{word()}{dot}{r.choice(['com', 'org', 'net', 'example.com', 'de', 'fr'])}"

    def positive() -> str:
        c, p = card(), (digits(3), digits(3), digits(4))
        sep = r.choice([".", "/", "_", "  ", "- "])
        return r.choice([
            email(), email(), sep.join(c[i : i + 4] for i in (0, 4, 8, 12)), f"{r.randint(1, 99)} {c}", f"{c} {r.randint(1, 999)}",
            f"({p[0]}) {p[1]}-{p[2]}", f"{p[0]}-{p[1]}-{p[2]}", f"{p[0]}.{p[1]}.{p[2]}", f"00{r.choice([1, 33, 44, 49, 34])} {digits(3)} {digits(3)} {digits(4)}",
            r.choice(["[.]", "(.)", "[dot]"]).join(str(r.randint(0, 255)) for _ in range(4)),
        ])

    def negative() -> str:
        return r.choice([
            f"{word()} at {word()}.{word()}", f"{word()} at {word()}.{r.choice(['com', 'org', 'de'])}", f"{word()} at {word()}. {word().capitalize()} {word()}", digits(16), digits(13), digits(18), f"{r.randint(10, 99)} {digits(15)}",
            "  ".join(digits(4) for _ in range(4)), ".".join(digits(4) for _ in range(4)), f"{digits(4)}/{digits(4)}/{digits(4)}/{digits(2)}",
            f"{digits(3)} {digits(3)} {digits(4)} {digits(3)}", f"00{r.randint(1, 9)}.{digits(9)}", f"0{digits(2)}-{digits(3)}-{digits(4)}-{digits(2)}", f"v{digits(1)}.{digits(2)}.{digits(1)}",
            "[.]".join(str(r.randint(256, 999)) for _ in range(4)), f"{r.randint(1900, 2100)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", "".join(r.choice("0123456789abcdef") for _ in range(40)),
        ])

    hints = ["email", "mail me", "phone", "tel", "call", "card", "visa", "pay", "ip", "host"]
    counters = ["order", "invoice", "no.", "number", "serial", "version"]
    out = []
    for i in range(n):
        text, places = "", []
        for _ in range(3):
            text += " ".join(word() for _ in range(r.randint(2, 7))) + " "
            if r.random() < 0.5:
                text += (r.choice(hints) + r.choice([" ", ": "])) if r.random() < 0.5 else ""
                x = positive()
                places.append((len(text), len(text) + len(x)))
            else:
                text += (r.choice(counters) + r.choice([" ", ": "])) if r.random() < 0.5 else ""
                x = negative()
            text += x + r.choice([" ", ", ", ". "])
        out.append((i, text + word(), places))
    return out


def _fit_tree(X: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int) -> tuple | float:
    """A regression tree on gradients: (feature, cut, left where <= cut, right), or a value."""
    value = float(-g.sum() / (h.sum() + 1.0))
    if depth == 0 or len(g) < 8:
        return value
    best, base = None, g.sum() ** 2 / (h.sum() + 1.0)
    for f in range(X.shape[1]):
        for cut in np.unique(X[:, f])[:-1]:
            left = X[:, f] <= cut
            if min(left.sum(), (~left).sum()) < 4:
                continue
            gain = g[left].sum() ** 2 / (h[left].sum() + 1.0) + g[~left].sum() ** 2 / (h[~left].sum() + 1.0) - base
            if best is None or gain > best[0] + 1e-12:
                best = (gain, f, float(cut), left)
    if best is None or best[0] < 1e-3:
        return value
    _, f, cut, left = best
    return f, cut, _fit_tree(X[left], g[left], h[left], depth - 1), _fit_tree(X[~left], g[~left], h[~left], depth - 1)


def _apply(tree: tuple | float, X: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(X), tree)
    f, cut, a, b = tree
    return np.where(X[:, f] <= cut, _apply(a, X), _apply(b, X))


def boost(X: np.ndarray, y: np.ndarray, trees: int = TREES, rate: float = RATE, depth: int = 3) -> list:
    """Logistic gradient boosting."""
    out, z = [], np.zeros(len(y))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        tree = _fit_tree(X, p - y, p * (1 - p), depth)
        z += rate * _apply(tree, X)
        out.append(tree)
    return out


def calibrate(z: np.ndarray, y: np.ndarray, precision: float = PRECISION) -> float:
    """The lowest score from which on at least this share of what scores as high is personal data; above all if there's none."""
    order = np.argsort(-z, kind="stable")
    share = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last = np.append(z[order][1:] != z[order][:-1], True) if len(z) else np.zeros(0, bool)
    good = np.flatnonzero((share >= precision) & last)
    return float(z[order][good[-1]]) if len(good) else 1e9


@functools.lru_cache(maxsize=1)
def _model(session: int) -> tuple[list, dict[str, float]]:
    """The trees and a threshold a kind; the examples' proposals are a few thousand rows."""
    spark = SparkSession.getActiveSession()
    made = examples()
    literal = F.lit(json.dumps([{"i": i, "t": t} for i, t, _ in made]))
    df = spark.range(1).select(F.explode(F.from_json(literal, "array<struct<i:int,t:string>>")).alias("r")).select("r.*")
    rows = _proposals(df).select("i", F.explode("c").alias("c")).select("i", "c.*").collect()
    places = {i: p for i, _, p in made}
    X = np.array([[r[f] for f in FEATURES] for r in rows], float)
    # A proposal is right if it lies inside personal data and misses at most what was put around it.
    y = np.array([float(any(a <= r.s and r.e <= b and (r.e - r.s) >= 0.8 * (b - a) - 4 for a, b in places[r.i])) for r in rows])
    train = np.array([r.i % 3 != 0 for r in rows])
    trees = boost(X[train], y[train])
    z = sum(RATE * _apply(t, X) for t in trees)
    return trees, {k: calibrate(z[~train & (X[:, 0] == j)], y[~train & (X[:, 0] == j)]) for j, k in enumerate(KINDS)}


def _score(trees: list, c: Column) -> Column:
    def one(tree: tuple | float) -> Column:
        if isinstance(tree, float):
            return F.lit(tree)
        f, cut, a, b = tree
        return F.when(c[FEATURES[f]] <= cut, one(a)).otherwise(one(b))

    return F.lit(RATE) * functools.reduce(lambda a, b: a + b, [one(t) for t in trees])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans, found) of every row.

    The counts and base_sha256 are of base spans, spans has those and the selected proposals as kind:start:end, by start, then
    kind in the order of KINDS, comma-joined, in code points with the end exclusive; found is the same as an array of structs.
    A proposal goes if it overlaps a base span, or another proposal of a higher score (or the same score and an earlier place).
    A null or empty text has no span: counts 0 and the hash of the empty string. Rows don't depend on one another, so repeated
    rows and ids are no special case. Other columns are ignored. One pass, no shuffle.
    """
    spark = docs.sparkSession
    trees, limits = _model(id(spark.sparkContext))
    df = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    df = _with_matches(df, BASE)
    for k in KINDS:
        valid = F.filter(f"x_{k}", functools.partial(lambda check, x: check(x["m"]), VALID[k]))
        df = df.withColumn(f"x_{k}", F.transform(valid, functools.partial(lambda kind, x: F.struct(x["s"].alias("s"), F.lit(KINDS.index(kind)).alias("k"), x["e"].alias("e")), k)))
    df = df.withColumn("base", F.array_sort(F.concat(*[f"x_{k}" for k in KINDS])))
    df = df.withColumns({f"n_{k}": F.size(f"x_{k}").cast("long") for k in KINDS}).drop(*[f"x_{k}" for k in KINDS])
    df = _proposals(df)
    # No proposals, no trees.
    scored = F.transform("c", lambda c: F.struct(c["s"].alias("s"), c["kind"].cast("int").alias("k"), c["e"].alias("e"), _score(trees, c).alias("z")))
    df = df.withColumn("p", F.when(F.size("c") > 0, scored).otherwise(F.array().cast("array<struct<s:int,k:int,e:int,z:double>>"))).drop("c")
    enough = F.create_map(*[F.lit(x) for j, k in enumerate(KINDS) for x in (j, limits[k])])
    df = df.withColumn("p", F.filter("p", lambda c: (c["z"] >= F.element_at(enough, c["k"])) & ~F.exists("base", lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"]))))
    better = lambda o, c: (o["s"] < c["e"]) & (c["s"] < o["e"]) & ((o["z"] > c["z"]) | ((o["z"] == c["z"]) & (F.struct(o["s"], o["e"], o["k"]) < F.struct(c["s"], c["e"], c["k"]))))
    added = F.filter("p", lambda c: ~F.exists("p", lambda o: better(o, c)))
    added = F.array_distinct(F.transform(added, lambda c: F.struct(c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e"))))
    df = df.withColumn("all", F.when(F.size("p") > 0, F.array_sort(F.concat("base", added))).otherwise(F.col("base")))
    names = F.array(*map(F.lit, KINDS))
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")
    found = F.transform("all", lambda x: F.struct(F.get(names, x["k"]).alias("kind"), x["s"].alias("start"), x["e"].alias("end")))
    return df.select(id_col, *[f"n_{k}" for k in KINDS], F.sha2(text("base"), 256).alias("base_sha256"), text("all").alias("spans"), found.alias("found"))
