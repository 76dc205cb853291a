"""Mixing to target weights by soft membership.

A labelled table says to which domain some documents belong.  A naive Bayes classifier on binned
statistics and on marker words of each domain turns every document's text into posterior
probabilities of the domains.  A document of w tokens with posteriors p, used at rate r, is then
expected to give r * w * p[d] tokens to domain d, and the rates are fitted so that these totals
match the targets: least squares over nonnegative rates by projected gradient steps.  Every step
starts from the rate 1 and projects once,

    r = clip(1 - p . s, lower, upper),        s: the sum of the gradient steps so far,

so a document's rate follows from its posteriors and as many numbers as there are domains.  What is
minimised is the sum of the squared gaps between the domains' shares of tokens and their targets
(plain and unweighted), plus (r - 1)**2 over the tokens times a small number, which makes the rates
unique and is lowered through ``EASES`` until the gaps are nothing or fall no more.  A step is one
aggregation over the table of documents for several choices at once: along the gradient, at a length
that is sure to gain, and along the gradient scaled by the second derivative (the joint totals of
the documents whose rates are free), more or less damped; the best is taken.  Only these sums come
to the driver.  All of it is DataFrame expressions.

Tokens and marker words are runs of [^\\x20\\x09-\\x0D].  Bounds: ``most_labelled`` rows, chosen by a hash of the id, are
read for marker words; ``markers`` words a domain and 64 bins a statistic bound the model.

Defined results: null and empty texts have 0 tokens and the rate that follows from their
posteriors.  Labels of unknown documents and null labels are ignored, a document with several
labels counts in each.  With no labels at all every posterior is even.  Repeated rows count and get
a rate each; a null id has one too.  An empty table gives an empty result.  Other columns are not
read, whatever their names; ``thin`` keeps all of them.  Targets are scaled to shares; what no rates
can reach is met in the least-squares sense, and ``shares`` reports what came out.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlake.llm.sample import bounded
from eventlake.plans import scratch

_SPACES = r"[\x20\x09-\x0D]+"
_BINS = 64
#: Binned statistics; each expression gives a whole number.
_STATISTICS = {
    "length": "cast(4 * log2(1 + tokens_) as int)",
    "word_chars": "cast(if(tokens_ > 0, 5 * chars_ / tokens_, 0) as int)",
    "symbols": "cast(ceil(if(tokens_ > 0, 8 * symbols_ / tokens_, 0)) as int)",
    "shouts": "cast(ceil(if(tokens_ > 0, 8 * shouts_ / tokens_, 0)) as int)",
    "variety": "cast(if(tokens_ > 0, 60 * distinct_ / tokens_, 0) as int)",
}


def _without(text: Column, characters: str) -> Column:
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), characters, text)


def _measured(rows: DataFrame, markers: dict[str, list[str]]) -> DataFrame:
    """rows (with text_) plus tokens_ and bins_, an array of bins: statistics, then a domain's marker words each."""
    text = F.coalesce(F.col("text_"), F.lit(""))
    counted = rows.withColumn("all_", F.split(F.lower(text), _SPACES))
    blank = lambda at: F.when(F.element_at("all_", at) == "", 1).otherwise(0)  # noqa: E731  before a first or after a last space
    counted = counted.withColumns(
        {
            "tokens_": F.greatest(F.size("all_") - blank(1) - blank(-1), F.lit(0)).cast("long"),
            "chars_": F.length(text),
            "symbols_": F.length(text) - F.length(_without(text, "#*$%&|<>")),
            "shouts_": F.length(text) - F.length(_without(text, "!")),
            "words_": F.array_distinct("all_"),
        }
    ).drop("all_")
    every = sorted({w for found in markers.values() for w in found})
    found = F.array_intersect("words_", F.array(*[F.lit(w) for w in every])) if every else F.array().cast("array<string>")
    counted = counted.withColumns({"distinct_": F.size("words_"), "found_": found})
    bins = [F.expr(x) for x in _STATISTICS.values()]
    bins += [F.size(F.array_intersect("found_", F.array(*[F.lit(w) for w in markers[d]]))) if markers[d] else F.lit(0) for d in markers]
    clipped = F.array(*[F.least(F.greatest(b.cast("int"), F.lit(0)), F.lit(_BINS - 1)) for b in bins])
    return counted.withColumn("bins_", clipped).drop("chars_", "symbols_", "shouts_", "words_", "distinct_", "found_")


def marker_words(labelled: DataFrame, domains: list[str], markers: int) -> dict[str, list[str]]:
    """The words that speak most for each domain; ``labelled`` has text_ and domain_."""
    texts = {r["domain_"]: r["n_"] for r in labelled.groupBy("domain_").agg(F.count(F.lit(1)).alias("n_")).collect()}
    total = sum(texts.values())
    words = labelled.select(
        "domain_", F.explode(F.array_distinct(F.split(F.lower(F.coalesce("text_", F.lit(""))), _SPACES))).alias("word")
    ).where("word <> ''")
    seen = words.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_"), *[F.count(F.when(F.col("domain_") == d, 1)).alias(f"n{i}_") for i, d in enumerate(domains)]
    )
    seen = scratch.keep(seen.where("n_ >= 3"), "mix-words")
    out = {}
    for i, d in enumerate(domains):
        mine, rest = texts.get(d, 0) + 1.0, total - texts.get(d, 0) + 1.0
        gain = F.col(f"n{i}_") * F.log(((F.col(f"n{i}_") + 0.1) / mine) / ((F.col("n_") - F.col(f"n{i}_") + 0.1) / rest))
        best = seen.withColumn("gain_", gain).where((F.col(f"n{i}_") >= 3) & (F.col("gain_") > 2 * F.col(f"n{i}_")))
        out[d] = [r["word"] for r in best.orderBy(F.desc("gain_"), "word").limit(markers).select("word").collect()]
    return out


class Membership:
    """Domain posteriors of a document as expressions over tokens_ and bins_."""

    def __init__(self, domains: list[str], markers: dict[str, list[str]], priors: list[float], tables: list[list[list[float]]]):
        self.domains, self.markers, self.priors, self.tables = domains, markers, priors, tables

    def posteriors(self, measured: DataFrame, keep: list[str]) -> DataFrame:
        """``keep`` and tokens_ with p_, the array of posteriors."""
        logs = []
        for d in range(len(self.domains)):
            terms = [F.lit(self.priors[d])]
            for f, table in enumerate(self.tables):
                terms.append(F.element_at(F.array(*[F.lit(x) for x in table[d]]), F.element_at("bins_", f + 1) + 1))
            logs.append(reduce(lambda a, b: a + b, terms))
        scored = measured.select(*keep, "tokens_", F.array(*logs).alias("l_"))
        scored = scored.withColumn("e_", F.expr("transform(l_, x -> exp(x - array_max(l_)))"))
        return scored.select(*keep, "tokens_", F.expr("transform(e_, x -> x / aggregate(e_, 0D, (a, y) -> a + y))").alias("p_"))


def learn(docs: DataFrame, labelled: DataFrame, domains: list[str], id_col: str, text_col: str, markers: int, most_labelled: int) -> Membership:
    """Naive Bayes from ``labelled`` (id_, domain_)."""
    labelled = labelled.where(F.col("domain_").isin(domains) & F.col("id_").isNotNull()).distinct()
    some = bounded(labelled, "id_", most_labelled, "domain_")  # bounds the broadcast
    rows = docs.select(F.col(id_col).cast("long").alias("id_"), F.col(text_col).alias("text_"))
    texts = scratch.keep(rows.join(F.broadcast(some), "id_"), "mix-labelled")
    words = marker_words(texts, domains, markers)
    measured = _measured(texts, words)
    bins = measured.select("domain_", F.posexplode("bins_").alias("f_", "bin_")).groupBy("f_", "domain_", "bin_").agg(F.count(F.lit(1)).alias("n_"))
    counts = {(r["f_"], r["domain_"], r["bin_"]): r["n_"] for r in bins.collect()}  # at most features * domains * _BINS
    features = len(_STATISTICS) + len(domains)
    tables, sizes = [], [sum(n for (f, d, _), n in counts.items() if f == 0 and d == x) for x in domains]
    for f in range(features):
        near = [[sum(math.exp(-abs(b - c)) * counts.get((f, d, c), 0) for c in range(_BINS)) + 0.05 for b in range(_BINS)] for d in domains]
        tables.append([[math.log(x / sum(row)) for x in row] for row in near])  # neighbouring bins lend to each other
    priors = [math.log((n + 1) / (sum(sizes) + len(domains))) for n in sizes]
    return Membership(domains, words, priors, tables)


EASES = tuple(10.0**-k for k in range(2, 9))
_DAMPING = (0.0, 1e-6, 1e-5, 1e-4, 1e-3, 1e-2)


def _rate(sums: list[float], feature: Column, low: Column, high: float) -> Column:
    """The rate after steps that sum to ``sums``; ``feature`` is the array they are for."""
    return F.least(F.greatest(F.lit(1.0) - _dot(feature, F.array(*[F.lit(float(x)) for x in sums]), len(sums)), low), F.lit(high))


def _dot(a: Column, b: Column, n: int) -> Column:
    return reduce(lambda t, x: t + x, [F.element_at(a, i + 1) * F.element_at(b, i + 1) for i in range(n)])


def _solve(m: list[list[float]], y: list[float]) -> list[float]:
    """m x = y by elimination; m is small and positive definite."""
    n = len(y)
    a = [[*row, v] for row, v in zip(m, y, strict=True)]
    for i in range(n):
        best = max(range(i, n), key=lambda k: abs(a[k][i]))
        a[i], a[best] = a[best], a[i]
        for k in range(n):
            if k != i:
                factor = a[k][i] / a[i][i]
                a[k] = [u - factor * v for u, v in zip(a[k], a[i], strict=True)]
    return [a[i][n] / a[i][i] for i in range(n)]


@dataclass
class Fit:
    """sums: of the steps; gaps: share minus target for each domain; settled: False if ``rounds`` ended it."""

    sums: list[float]
    gaps: list[float]
    settled: bool
    rounds: int


def _steps(members: DataFrame, total: float, points: list[list[float]], goal: list[float], ease: float) -> list[tuple[float, list[float], list[list[float]]]]:
    """(gain, gradient, curvature) of the dual at each of the points; ``members`` has w_, q_ and low_ and high_."""
    n = len(goal)
    # A constant array, not numbers in the plan's code, so that it is compiled once.
    at = F.array(*[F.array(*[F.lit(float(x)) for x in p]) for p in points])
    rows = members.select("w_", "q_", "low_", "high_", F.posexplode(at).alias("at_", "s_"))
    rows = rows.select("w_", "q_", "low_", "high_", "at_", _dot(F.col("q_"), F.col("s_"), n).alias("dot_"))
    rows = rows.withColumn("r_", F.least(F.greatest(1 - F.col("dot_"), F.col("low_")), F.col("high_")))
    free = F.when((F.col("r_") > F.col("low_")) & (F.col("r_") < F.col("high_")), F.col("w_")).otherwise(0.0)
    q = [F.element_at("q_", i + 1) for i in range(n)]
    r, w = F.col("r_"), F.col("w_")
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    sums = rows.groupBy("at_").agg(
        F.sum(w * ((r - 1) * (r - 1) / 2 + F.col("dot_") * r)), *[F.sum(w * r * x) for x in q], *[F.sum(free * q[i] * q[j]) for i, j in pairs]
    )
    found = {row[0]: [x / total for x in row[1:]] for row in sums.collect()}  # a row per point
    out = []
    for k, point in enumerate(points):
        got = found[k]
        gain = got[0] - sum(s * g for s, g in zip(point, goal, strict=True)) - ease / 2 * sum(s * s for s in point)
        gradient = [t - g - ease * s for t, g, s in zip(got[1 : n + 1], goal, point, strict=True)]
        curve = [[0.0] * n for _ in range(n)]
        for (i, j), x in zip(pairs, got[n + 1 :], strict=True):
            curve[i][j] = curve[j][i] = x
        out.append((gain, gradient, [[x + ease * (i == j) for j, x in enumerate(row)] for i, row in enumerate(curve)]))
    return out


def fit_rates(members: DataFrame, targets: list[float], low: Column, high: float, rounds: int = 300, tolerance: float = 1e-7) -> Fit:
    """The steps whose rates bring the domains' shares to ``targets``; ``members`` has tokens_ and p_.

    Where rates only thin (``high`` is at most 1), shares are those of the tokens that stay, else
    those of all tokens.  It ends when no gap exceeds ``tolerance`` or what is left of the squares
    falls by less than a thousandth; if ``rounds`` end it, it warns.
    """
    n = len(targets)
    total = members.agg(F.sum(F.col("tokens_").cast("double"))).first()[0]
    if not total:
        return Fit([0.0] * n, [0.0] * n, True, 0)
    goal = [0.0] * n if high <= 1 else [t / sum(targets) for t in targets]  # of what stays, the sum of r w (p - want) is to be 0
    rows = members.select(F.col("tokens_").cast("double").alias("w_"), _feature(targets, high).alias("q_"), low.cast("double").alias("low_"), F.lit(float(high)).alias("high_"))
    sums, gaps, done, last = [0.0] * n, [math.inf] * n, 0, math.inf
    largest = lambda xs: max(map(abs, xs))
    for k, ease in enumerate(EASES):
        # What was free stays where it was; what is out of reach is pushed in proportion.
        points = [sums, [10 * s for s in sums]] if k else [sums]
        tried, done = _steps(rows, total, points, goal, ease), done + 1
        best = max(range(len(points)), key=lambda i: tried[i][0])
        sums, (gain, gradient, curve) = points[best], tried[best]
        while largest(gradient) > max(1e-9, 1e-3 * ease) and done < rounds:
            points = [[s + g / 2 for s, g in zip(sums, gradient, strict=True)]]  # no second derivative exceeds 2
            for damping in _DAMPING:
                scaled = _solve([[x + damping * (i == j) for j, x in enumerate(row)] for i, row in enumerate(curve)], gradient)
                points.append([s + d for s, d in zip(sums, scaled, strict=True)])
            tried, done = _steps(rows, total, points, goal, ease), done + 1
            best = max(range(len(points)), key=lambda i: tried[i][0])
            if tried[best][0] <= gain + 1e-15 * abs(gain):  # as good as numbers tell, but the gradient may still fall
                best = min(range(len(points)), key=lambda i: largest(tried[i][1]))
                if largest(tried[best][1]) >= largest(gradient) * (1 - 1e-3):
                    break
            sums, (gain, gradient, curve) = points[best], tried[best]
        gaps = [g + ease * s for g, s in zip(gradient, sums, strict=True)]
        now = sum(g * g for g in gaps)
        if largest(gaps) < tolerance or last - now < 1e-3 * now or done >= rounds:
            break
        last = now
    if done >= rounds:
        warnings.warn(f"rates did not settle in {rounds} rounds; gaps {gaps}", stacklevel=2)
    return Fit(sums, gaps, done < rounds, done)


def _feature(targets: list[float], high: float) -> Column:
    """The array that ``Fit.sums`` belong to."""
    if high > 1:
        return F.col("p_")
    return F.array(*[F.element_at("p_", i + 1) - F.lit(t / sum(targets)) for i, t in enumerate(targets)])


def weigh(
    docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text",
    high: float = 8.0, markers: int = 48, most_labelled: int = 5_000,
) -> DataFrame:
    """One row per document: id, n_tokens, p_<domain> and rate; ``labelled`` has id_ and domain_."""
    domains = sorted(targets)
    model = learn(docs, labelled, domains, id_col, text_col, markers, most_labelled)
    rows = docs.select(F.col(id_col).cast("long").alias("id_"), F.col(text_col).alias("text_"))
    members = scratch.keep(model.posteriors(_measured(rows, model.markers), ["id_"]), "mix-members")
    low, want = F.lit(0.0), [targets[d] for d in domains]
    fit = fit_rates(members, want, low, high)
    return members.select(
        F.col("id_").alias(id_col), F.col("tokens_").alias("n_tokens"),
        *[F.element_at("p_", i + 1).alias(f"p_{d}") for i, d in enumerate(domains)], _rate(fit.sums, _feature(want, high), low, high).alias("rate"),
    )


def shares(weighed: DataFrame, targets: dict[str, float]) -> DataFrame:
    """domain, target, share (expected tokens at the rates over all tokens) and gap, of what ``weigh`` returns."""
    total = sum(targets.values())
    sums = weighed.agg(F.sum("n_tokens").alias("t_"), *[F.sum(F.col("n_tokens") * F.col("rate") * F.col(f"p_{d}")).alias(f"s_{d}") for d in targets])
    rows = F.array(*[F.struct(F.lit(d).alias("domain"), F.lit(x / total).alias("target"), (F.col(f"s_{d}") / F.col("t_")).alias("share")) for d, x in targets.items()])
    return sums.select(F.explode(rows).alias("x_")).select("x_.*").withColumn("gap", F.col("share") - F.col("target"))


def thin(
    docs: DataFrame, labelled: DataFrame, targets: dict[str, float], protected: str, id_col: str = "doc_id", text_col: str = "text",
    protect_from: float = 0.1, markers: int = 48, most_labelled: int = 5_000,
) -> DataFrame:
    """The rows of ``docs`` that stay when rates are at most 1, with all their columns.

    A document whose posterior of the protected domain is at least ``protect_from`` has rate 1.
    The others stay with a chance of their rate, by a hash of the id and text.
    """
    domains = sorted(targets)
    model = learn(docs, labelled, domains, id_col, text_col, markers, most_labelled)
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_"), F.col(id_col).cast("long").alias("id_"), F.col(text_col).alias("text_")
    )
    members = model.posteriors(_measured(rows.select("id_", "text_"), model.markers), [])
    low = F.when(F.element_at("p_", domains.index(protected) + 1) >= protect_from, 1.0).otherwise(0.0)
    want = [targets[d] for d in domains]
    fit = fit_rates(scratch.keep(members, "mix-members"), want, low, 1.0)
    draw = (F.pmod(F.xxhash64("id_", "text_"), F.lit(1_000_003)) + 0.5) / 1_000_003
    chosen = model.posteriors(_measured(rows.withColumn("draw_", draw), model.markers), ["row_", "draw_"])
    # A filter that could move below the posteriors would repeat them for each use; the row number holds it above.
    held = chosen.withColumn("at_", F.monotonically_increasing_id())
    return held.where((F.col("at_") >= 0) & (F.col("draw_") < _rate(fit.sums, _feature(want, 1.0), low, 1.0))).select("row_.*")


def label_domains(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_, domain_) from a table with quality and toxic: toxic, low or high."""
    domain = F.when(F.col("toxic") > 0, "toxic").when(F.col("quality") > 0, "high").when(F.col("quality") <= 0, "low")
    return labels.select(F.col(id_col).cast("long").alias("id_"), domain.alias("domain_")).where(F.col("domain_").isNotNull()).distinct()
