"""Personal data by candidate gradient boosting, with DataFrame functions only.

For each kind a pattern and a check give the base spans, which always count. Matches that fail
the check, and what wider patterns propose inside these and in the gaps between matches, are
further candidates; they may overlap. A candidate is described by a few small numbers about
its format and its context. Over all documents only the counts of each description matter:
boosted trees learn from them how likely it is that of a base span, and a held-out fold gives
each kind the threshold from which the calibrated share of base spans is high enough. The
trees become column expressions. Everything about a document is computed in its own row.
"""
from __future__ import annotations

from math import exp, log
from typing import Any, Callable, NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from spatialqa.llm.common import id_remainder, text_of

KINDS = ("email", "ip", "card", "phone")
#: Patterns as stated, but possessive and tried only where a run starts, so that a long run costs no more than its length.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What is proposed inside a match that fails its check.
INSIDE = {
    "card": r"(?<![0-9])(?:[0-9]{14,19}|[0-9]{4}(?:\x20[0-9]{4}){3}|[0-9]{4}(?:-[0-9]{4}){3}|[0-9]{4}\x20[0-9]{6}\x20[0-9]{5})(?![0-9])",
    "phone": r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])",
}
#: What is proposed in the gaps between matches.
BETWEEN = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:@|\x20?[\[(](?:at|AT)[\])]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(](?:dot|DOT)[\])]\x20?)[A-Za-z0-9-]++)*+",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "phone": r"(?<![0-9+])(?:00[1-9][0-9]{0,2}[\x20.-]?)?(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
#: What is proposed in whole texts; such a span meets none that passes.
ANYWHERE = {"card": r"(?<![0-9])(?<![0-9][\x20-])[0-9]{4}([./_])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])(?![\x20-][0-9])"}
#: A text without this has no match, inside or between.
NEEDS = {"email": r"@|[\[(](?:at|AT)[\])]", "ip": r"[0-9]\.[0-9]|[0-9A-Fa-f]:[0-9A-Fa-f]", "card": r"[0-9][\x20./_-]?[0-9]", "phone": r"[0-9]"}
#: A text without this has no match of any kind.
NEEDED = r"[0-9@]|[\[(](?:at|AT)[\])]|[A-Fa-f]:[A-Fa-f]"
PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
HINTS = {"email": r"mail|contact|write to", "ip": r"\bip\b|host|server|addr", "card": r"card|visa|credit|kart|pay", "phone": r"phone|tel|call|fax|mobil"}
NUMBERED = r"(?:\b(?:no|nr|num|page|item|id|order|isbn|version|ver|v)|#)[.:\x20]{0,2}$"
#: Features and their values; the product bounds the counts that reach the driver.
FEATURES = {"valid": 2, "marker": 3, "left": 5, "right": 5, "hint": 2, "numbered": 2, "size": 4}
#: Rounds of boosting, step, smoothing of a leaf; folds of which one calibrates; share and number of base spans above a threshold.
TREES, RATE, SMOOTH, FOLDS, PRECISE, LEAST = 24, 0.4, 1.0, 5, 0.9, 10
#: Sums run in blocks of this many, so that many matches in one text cost little.
RUN = 64

SPAN = "array<struct<start:int,end:int,found:string,before:string,after:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(sizes: Column) -> Column:
    """For each of the integers the sum of those before it; not for an empty array."""
    def within(values: Column, first: Column) -> Column:
        zero = F.struct(first.alias("s"), F.array().cast("array<int>").alias("out"))
        step = lambda acc, x: F.struct((acc["s"] + x).alias("s"), F.concat(acc["out"], F.array(acc["s"])).alias("out"))
        return F.aggregate(values, zero, step, lambda acc: acc["out"])

    total = lambda values: F.aggregate(values, F.lit(0), lambda a, x: a + x)
    cut = lambda v: F.sequence(F.lit(0), F.floor((F.size(v) - 1) / RUN).cast("int"))
    return let(sizes, lambda v: let(
        F.transform(cut(v), lambda b: total(F.slice(v, b * RUN + 1, RUN))),
        lambda totals: F.flatten(F.transform(cut(v), lambda b: within(F.slice(v, b * RUN + 1, RUN), total(F.slice(totals, F.lit(1), b)))))))


def spans(text: Column, pattern: str) -> Column:
    """SPAN: the matches of a pattern with their places in code points and the text up to the next match on either side."""
    both = F.struct(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))

    def placed(t: Column) -> Column:
        steps = F.transform(t["m"], lambda m, i: F.char_length(m) + F.char_length(F.get(t["p"], i)))

        def one(starts: Column) -> Column:
            def span(m: Column, i: Column) -> Column:
                start = F.get(starts, i) + F.char_length(F.get(t["p"], i))
                return F.struct(start.alias("start"), (start + F.char_length(m)).alias("end"), m.alias("found"),
                                F.get(t["p"], i).alias("before"), F.get(t["p"], i + 1).alias("after"))
            return F.transform(t["m"], span)
        return F.when(F.size(t["m"]) == 0, F.array().cast(SPAN)).otherwise(let(running(steps), one))

    return let(both, placed)


def shifted(found: Column, by: Column, before: Column, after: Column) -> Column:
    """Spans within a piece of text, with their places in the whole and the context around the piece."""
    return F.transform(found, lambda x: F.struct((x["start"] + by).alias("start"), (x["end"] + by).alias("end"), x["found"].alias("found"),
                                                 F.concat(before, x["before"]).alias("before"), F.concat(x["after"], after).alias("after")))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    doubled = lambda d: F.translate(d, "0123456789", "0246813579")

    def value(backwards: Column) -> Column:
        at = lambda i: F.substring(backwards, i, F.lit(1))
        digit = lambda i: F.when(i % 2 == 1, at(i)).otherwise(doubled(at(i))).cast("int")
        return F.aggregate(F.sequence(F.lit(1), F.length(backwards)), F.lit(0), lambda a, i: a + digit(i)) % 10 == 0

    return let(F.reverse(number), value)


def passes(kind: str, found: Column) -> Column:
    """The check of a kind's base matches."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return found.rlike(rf"^{PART}(?:\.{PART}){{3}}$")
    if kind == "card":
        return let(digits(found), lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False))
    return F.length(digits(found)).between(10, 15)


def described(kind: str, x: Column) -> Column:
    """The FEATURES of a span, and its place."""
    found, before, after = x["found"], F.lower(F.right(x["before"], F.lit(24))), F.left(x["after"], F.lit(1))
    last = F.right(x["before"], F.lit(1))
    edge = lambda c, marks: (F.when((c == "") | c.rlike(r"\s"), 0).when(c.rlike(r"\p{L}"), 1).when(c.rlike("[0-9]"), 2).when(c.rlike(marks), 3).otherwise(4))
    valid, marker, size = passes(kind, found), F.lit(0), F.lit(0)
    if kind == "email":
        valid = found.rlike(r"[A-Za-z]{2,}$")
        marker = found.rlike(r"(?:\.|[\[(](?:dot|DOT)[\])]\x20?)[A-Za-z0-9-]+$").cast("int")
    elif kind == "ip":
        valid = valid | found.contains(":")
    elif kind == "card":
        marker = digits(found).eqNullSafe(found).cast("int") + 2 * found.rlike(r"^[0-9]{4}([\x20./_-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}$").cast("int")
        n = F.length(digits(found))
        size = F.when(n < 14, 0).when(n == 16, 1).when(n <= 19, 2).otherwise(3)
    else:
        marker = F.when(found.startswith("+"), 2).when(found.rlike(r"^(?:00|\()"), 1).otherwise(0)
    return F.struct(x["start"], x["end"], valid.cast("int").alias("valid"), marker.cast("int").alias("marker"), edge(last, r"['\"(<\[{=:]").alias("left"),
                    edge(after, r"[.,;:!?)'\"\]>}]").alias("right"), before.rlike(HINTS[kind]).cast("int").alias("hint"),
                    before.rlike(NUMBERED).cast("int").alias("numbered"), size.cast("int").alias("size"))


def candidates(kind: str, text: Column) -> Column:
    """struct(base, others): described spans that pass, and those a model decides on."""
    def both(t: Column, found: Column) -> Column:
        good = F.filter(found, lambda x: passes(kind, x["found"]))
        fails = F.filter(found, lambda x: ~passes(kind, x["found"]))
        others = [fails]
        if kind in INSIDE:
            others.append(F.flatten(F.transform(fails, lambda x: shifted(spans(x["found"], INSIDE[kind]), x["start"], x["before"], x["after"]))))
        if kind in BETWEEN:
            # A gap stands before each match, one more behind the last.
            gaps = F.concat(F.transform(found, lambda x: F.struct((x["start"] - F.char_length(x["before"])).alias("start"), x["before"].alias("text"))),
                            F.when(F.size(found) == 0, F.array(F.struct(F.lit(0).alias("start"), t.alias("text"))))
                            .otherwise(let(F.element_at(found, -1), lambda x: F.array(F.struct(x["end"].alias("start"), x["after"].alias("text"))))))
            others.append(F.flatten(F.transform(gaps, lambda g: shifted(spans(g["text"], BETWEEN[kind]), g["start"], F.lit(""), F.lit("")))))
        if kind in ANYWHERE:
            others.append(spans(t, ANYWHERE[kind]))
        return F.struct(F.transform(good, lambda x: described(kind, x)).alias("base"), F.transform(F.concat(*others), lambda x: described(kind, x)).alias("others"))

    # A text without what the kind needs is empty to all its patterns.
    return let(F.when(text.rlike(NEEDS[kind]), text).otherwise(""), lambda t: let(spans(t, BASE[kind]), lambda found: both(t, found)))


def all_candidates(text: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a struct with the candidates of each kind."""
    return let(F.when(text.rlike(NEEDED), text).otherwise(""), lambda t: let(F.struct(*[candidates(k, t).alias(k) for k in KINDS]), body))


class Model(NamedTuple):
    """For each kind its trees, each (feature, limit, (feature, limit, low, high), (feature, limit, low, high)), and the least sum that counts; None: no candidate counts."""
    trees: dict[str, list[tuple]]
    least: dict[str, float | None]


def sum_of(trees: list[tuple], values: dict[str, int]) -> float:
    total = 0.0
    for feature, limit, *sides in trees:
        name, other, low, high = sides[values[feature] > limit]
        total += high if values[name] > other else low
    return total


def expression(trees: list[tuple], x: Column) -> Column:
    """The sum of the trees over a described span."""
    leaf = lambda s: F.when(x[s[0]] > s[1], s[3]).otherwise(s[2])
    total = F.lit(0.0)
    for feature, limit, low, high in trees:
        total = total + F.when(x[feature] > limit, leaf(high)).otherwise(leaf(low))
    return total


def best_split(cells: list[tuple[dict, float, float]]) -> tuple[float, str, int, float, float]:
    """(gain, feature, limit, low leaf, high leaf) over cells of (values, gradient, weight)."""
    leaf = lambda g, h: RATE * g / (h + SMOOTH)
    all_g, all_h = sum(c[1] for c in cells), sum(c[2] for c in cells)
    best = (0.0, "valid", FEATURES["valid"], leaf(all_g, all_h), 0.0)
    for name, n in FEATURES.items():
        g, h = [0.0] * n, [0.0] * n
        for values, gradient, weight in cells:
            g[values[name]] += gradient
            h[values[name]] += weight
        low_g = low_h = 0.0
        for limit in range(n - 1):
            low_g, low_h = low_g + g[limit], low_h + h[limit]
            gain = low_g ** 2 / (low_h + SMOOTH) + (all_g - low_g) ** 2 / (all_h - low_h + SMOOTH) - all_g ** 2 / (all_h + SMOOTH)
            if gain > best[0] + 1e-9:
                best = (gain, name, limit, leaf(low_g, low_h), leaf(all_g - low_g, all_h - low_h))
    return best


def boosted(counts: list[tuple[dict, int, int]]) -> list[tuple]:
    """Trees of two levels for the logistic loss, from (values, base spans, others)."""
    sums, trees = [0.0] * len(counts), []
    for _ in range(TREES):
        cells = []
        for (values, yes, no), s in zip(counts, sums):
            p = 1 / (1 + exp(-s))
            cells.append((values, yes * (1 - p) - no * p, (yes + no) * p * (1 - p)))
        _, name, limit, *_ = best_split(cells)
        sides = [best_split([c for c in cells if (c[0][name] > limit) == high])[1:] for high in (False, True)]
        trees.append((name, limit, *sides))
        sums = [s + sum_of(trees[-1:], c[0]) for s, c in zip(sums, counts)]
    # Trees of the same splits become one.
    merged: dict[tuple, list[float]] = {}
    for name, limit, low, high in trees:
        leaves = merged.setdefault((name, limit, low[:2], high[:2]), [0.0] * 4)
        merged[name, limit, low[:2], high[:2]] = [a + b for a, b in zip(leaves, (*low[2:], *high[2:]))]
    return [(name, limit, (*low, *x[:2]), (*high, *x[2:])) for (name, limit, low, high), x in merged.items()]


def threshold(scored: list[tuple[float, int, int]]) -> float | None:
    """The least sum from which the calibrated share of base spans is PRECISE.

    The share rises with the sum: neighbours (sum, base spans, others) that don't rise are pooled.
    """
    pools: list[list[float]] = []
    for s, yes, no in sorted(scored):
        pools.append([s, yes, no])
        while len(pools) > 1 and (pools[-2][0] == pools[-1][0] or pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]):
            _, y, n = pools.pop()
            pools[-1][1] += y
            pools[-1][2] += n
    return next((s for s, yes, no in pools if yes >= LEAST and yes >= PRECISE * (yes + no)), None)


def learn(docs: DataFrame) -> Model:
    """The model of all candidates in ``docs``; the driver sees one count for each description, of which there are at most the product of FEATURES for a kind, fold and label."""
    def tagged(c: Column) -> Column:
        each = [F.transform(c[k][side], lambda x: F.struct(F.lit(i).alias("kind"), F.lit(side == "base").alias("good"), *[x[f].alias(f) for f in FEATURES]))  # noqa: B023
                for i, k in enumerate(KINDS) for side in ("base", "others")]
        return F.concat(*each)

    rows = docs.select((id_remainder(FOLDS) == 0).alias("held_out"), F.explode(all_candidates(text_of(), tagged)).alias("c"))
    each = rows.select("held_out", "c.*")
    counts = each.groupBy("held_out", "kind", *FEATURES).agg(F.count_if("good").alias("yes"), F.count_if(~F.col("good")).alias("no")).collect()
    return fit([r.asDict() for r in counts])


def fit(counts: list[dict[str, Any]]) -> Model:
    trees: dict[str, list[tuple]] = {}
    least: dict[str, float | None] = {}
    order = lambda c: (tuple(c[0].values()), c[1], c[2])
    for i, kind in enumerate(KINDS):
        of = lambda held: sorted((({f: r[f] for f in FEATURES}, r["yes"], r["no"]) for r in counts if r["kind"] == i and r["held_out"] == held), key=order)  # noqa: B023, E731
        known, held = of(False), of(True)
        # What fails is never a base span, even where the corpus has no such candidate: each description has a twin that fails, as often.
        known += [({**v, "valid": 0}, 0, yes) for v, yes, _ in known if yes]
        trees[kind] = boosted(known) if known else []
        least[kind] = threshold([(round(sum_of(trees[kind], v), 9), yes, no) for v, yes, no in held]) if known else None
    return Model(trees, least)


def chosen(kind: str, model: Model, others: Column) -> Column:
    """The candidates that count, without those that begin inside one that began before or is longer."""
    if model.least[kind] is None:
        return F.array().cast("array<struct<start:int,end:int>>")
    fits = F.filter(others, lambda x: F.round(expression(model.trees[kind], x), 9) >= model.least[kind])
    # Sorted by start, the longest first.
    ranked = F.array_sort(F.transform(fits, lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("back"))))
    zero = F.struct(F.lit(-1).alias("upto"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        fresh = x["start"] >= acc["upto"]
        return F.struct(F.when(fresh, -x["back"]).otherwise(acc["upto"]).alias("upto"),
                        F.when(fresh, F.concat(acc["out"], F.array(F.struct(x["start"].alias("start"), (-x["back"]).alias("end"))))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(ranked, zero, step, lambda acc: acc["out"])


def find(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``base`` and ``spans``, arrays of (start, kind, end), by start, then kind (its place in KINDS).

    Places are code points, the end is exclusive; ``spans`` are the base spans and the
    candidates that count. A null text counts as empty and has no spans. Repeated rows, and
    rows without an id, are treated alike, each by its own text, of any length. Columns of
    ``docs`` named ``base`` or ``spans`` are replaced, all others pass through. An empty table
    stays empty; a model of too few examples adds nothing to the base spans.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("base", "spans")]
    named = lambda i, xs: F.transform(xs, lambda x: F.struct(x["start"].alias("start"), F.lit(i).alias("kind"), x["end"].alias("end")))

    def both(t: Column) -> Column:
        base = F.concat(*[named(i, t[k]["base"]) for i, k in enumerate(KINDS)])
        more = F.concat(*[named(i, chosen(k, model, t[k]["others"])) for i, k in enumerate(KINDS)])
        return F.struct(F.array_sort(base).alias("base"), F.array_sort(F.concat(base, more)).alias("spans"))

    found = all_candidates(text_of(), both)
    taken = {c.lower() for c in docs.columns}
    name = next(n for n in ("_found", *(f"_found{i}" for i in range(len(taken) + 1))) if n not in taken)
    return docs.select(*kept, found.alias(name)).select(*kept, F.col(f"{name}.base").alias("base"), F.col(f"{name}.spans").alias("spans"))


def written(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with every span of its texts replaced by its kind in brackets; of spans that meet, the first names the place. A null text stays null."""
    def step(acc: Column, x: Column) -> Column:
        fresh = x["start"] >= acc["upto"]
        gap = F.substring(F.col("text"), acc["upto"] + 1, F.greatest(x["start"] - acc["upto"], F.lit(0)))
        mark = F.concat(F.lit("["), F.upper(F.get(F.array(*map(F.lit, KINDS)), x["kind"])), F.lit("]"))
        return F.struct(F.greatest(acc["upto"], x["end"]).alias("upto"), F.when(fresh, F.concat(acc["parts"], F.array(gap, mark))).otherwise(acc["parts"]).alias("parts"))

    zero = F.struct(F.lit(0).alias("upto"), F.array().cast("array<string>").alias("parts"))
    new = F.aggregate("spans", zero, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(F.col("text"), acc["upto"] + 1, F.char_length("text"))))
    found = find(docs.drop("base", "spans"), model)
    return found.select(*[new.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("base", "spans")])
