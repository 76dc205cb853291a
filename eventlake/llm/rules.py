"""Quality rules as learned decision lists.

Statistics of whole texts are labelled, and rules of the form "a >= s and b <= t" are learned by
sequential covering: a conjunction is grown, a threshold at a time, on half of the labelled rows by
information gain, pruned from its end on a quarter, and kept if it covers rows of the last quarter
and is precise there; the rows it covers are set aside and the next one is grown.  The list, in
order, becomes one Spark conditional expression.  A row that no rule covers is kept.

At most ``most_rows`` labelled rows, chosen by a hash of the id, are used to fit.  Every text gets
its statistics, and whole.

Defined results: a null text has no words.  Texts without words have all ratios 0.  Without labels
of both kinds there are no rules.  Several labels of one id count once, with the lowest quality.
Repeated rows get equal verdicts, and equal statistics do.  An empty table gives an empty result.
Other columns than id and text are not read, whatever their names.  Ids may be any long, or null.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlake.llm.sample import bounded
from eventlake.plans import scratch

_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeated(tokens: list[bytes]) -> int:
    """Words that lie in a window of three words found more than once."""
    n = len(tokens)
    if n < 4:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in tokens), np.int64, n)
    size = len(numbers)
    if size == n:
        return 0
    pairs = ids[:-1] * size + ids[1:]
    if size > 2_000_000:  # three numbers no longer fit 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, which, counts = np.unique(pairs[:-1] * size + ids[2:], return_inverse=True, return_counts=True)
    at = np.flatnonzero(counts[which] > 1)
    marked = np.zeros(n, bool)
    for k in range(3):
        marked[at + k] = True
    return int(marked.sum())


def statistics(text: str | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of one text."""
    text = text or ""
    tokens = text.encode("utf-8", "surrogatepass").split()  # bytes split at \x20 and \x09-\x0D only
    lines = Counter(text.split("\n"))
    repeats = sum(n - 1 for line, n in lines.items() if n > 1 and line.strip(_SPACES))
    chars = len(text) - sum(map(text.count, _SPACES))
    return len(tokens), chars, sum(map(text.count, _SYMBOLS)), repeats, _repeated(tokens)


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_ and STATISTICS."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame([statistics(t) for t in batch["text_"]], columns=list(STATISTICS), dtype="int64")
            yield out.assign(id_=batch["id_"].array)

    # The id goes as text, as pandas has no long that may be null.
    rows = docs.select(F.col(id_col).cast("long").cast("string").alias("id_"), F.coalesce(F.col(text_col), F.lit("")).alias("text_"))
    return rows.mapInPandas(run, ", ".join(f"{s} long" for s in STATISTICS) + ", id_ string").withColumn("id_", F.col("id_").cast("long"))


#: What thresholds are put on, each from the statistics.
MEASURES = {
    "words": lambda c: c["n_words"] * 1.0,
    "chars_per_word": lambda c: c["word_chars"] / c["n_words"],
    "symbols_per_word": lambda c: c["n_symbols"] / c["n_words"],
    "dup_lines_per_word": lambda c: c["n_dup_lines"] / c["n_words"],
    "repeat_share": lambda c: c["n_repeat_words"] / c["n_words"],
}


@dataclass(frozen=True)
class Test:
    measure: str
    at_least: bool
    threshold: float

    def of(self, values: dict[str, np.ndarray]) -> np.ndarray:
        x = values[self.measure]
        return x >= self.threshold if self.at_least else x <= self.threshold

    def column(self) -> Column:
        columns = {s: F.col(s) for s in STATISTICS}
        columns["n_words"] = F.greatest(F.col("n_words"), F.lit(1))
        x = MEASURES[self.measure](columns)
        return x >= F.lit(self.threshold) if self.at_least else x <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.measure} {'>=' if self.at_least else '<='} {self.threshold:g}"


@dataclass(frozen=True)
class Rule:
    tests: tuple[Test, ...]

    def covers(self, values: dict[str, np.ndarray]) -> np.ndarray:
        return np.logical_and.reduce([t.of(values) for t in self.tests])

    def column(self) -> Column:
        out = self.tests[0].column()
        for t in self.tests[1:]:
            out = out & t.column()
        return out

    def __str__(self) -> str:
        return "reject if " + " and ".join(map(str, self.tests))


def _measures(rows: pd.DataFrame) -> dict[str, np.ndarray]:
    columns = {s: rows[s].to_numpy(np.float64) for s in STATISTICS}
    columns["n_words"] = np.maximum(columns["n_words"], 1.0)
    return {k: np.asarray(f(columns), np.float64) for k, f in MEASURES.items()}


def _cuts(x: np.ndarray, most: int = 64) -> np.ndarray:
    """Thresholds of six digits between distinct values."""
    values = np.unique(x)
    if len(values) > most:
        values = np.unique(np.quantile(values, np.linspace(0, 1, most)))
    middle = (values[1:] + values[:-1]) / 2
    return np.unique([float(f"{m:.6g}") for m in middle])


def _grow(values: dict[str, np.ndarray], bad: np.ndarray, longest: int) -> list[Test]:
    tests, inside = [], np.ones(len(bad), bool)
    while len(tests) < longest and (bad[inside].sum() < inside.sum()):
        p0, n0 = bad[inside].sum(), (~bad)[inside].sum()
        best, gain = None, 1e-9
        for name, x in values.items():
            for cut in _cuts(x[inside]):
                for at_least in (True, False):
                    hit = inside & (x >= cut if at_least else x <= cut)
                    p = bad[hit].sum()
                    if not p:
                        continue
                    g = p * (np.log2(p / hit.sum()) - np.log2(p0 / (p0 + n0)))
                    if g > gain:
                        best, gain = Test(name, at_least, float(cut)), g
        if best is None:
            break
        tests.append(best)
        inside &= best.of(values)
    return tests


def _prune(tests: list[Test], values: dict[str, np.ndarray], bad: np.ndarray) -> tuple[Test, ...]:
    """The beginning of the conjunction that is worth most on rows it was not grown on."""

    def worth(k: int) -> float:
        hit = Rule(tuple(tests[:k])).covers(values)
        p, n = bad[hit].sum(), (~bad)[hit].sum()
        return (p - n) / (p + n + 1)

    return tuple(tests[: max(range(1, len(tests) + 1), key=lambda k: (worth(k), -k))])


def learn(rows: pd.DataFrame, bad: np.ndarray, precision: float = 0.9, least: int = 3, longest: int = 4, most_rules: int = 16, seed: int = 7) -> list[Rule]:
    """Rules that reject rows like the bad ones."""
    values, rules = _measures(rows), []
    part = np.random.default_rng(seed).random(len(rows))
    left = np.ones(len(rows), bool)
    while len(rules) < most_rules:
        grow, prune, check = left & (part < 0.5), left & (part >= 0.5) & (part < 0.75), left & (part >= 0.75)
        if bad[grow].sum() < least:
            break
        tests = _grow({k: x[grow] for k, x in values.items()}, bad[grow], longest)
        if not tests:
            break
        rule = Rule(_prune(tests, {k: x[prune] for k, x in values.items()}, bad[prune]))
        hit = rule.covers(values) & left
        checked = hit & check
        p = bad[checked].sum()
        if not p or bad[hit].sum() < least or p < precision * checked.sum() or bad[hit].sum() < precision * hit.sum():
            break
        rules.append(rule)
        left &= ~hit
    return rules


def verdict(rules: list[Rule]) -> Column:
    """True for rows that the list keeps: one conditional expression, the rules in order."""
    if not rules:
        return F.lit(True)
    out = F.when(rules[0].column(), F.lit(False))
    for rule in rules[1:]:
        out = out.when(rule.column(), F.lit(False))
    return out.otherwise(F.lit(True))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", most_rows: int = 20_000, **options) -> list[Rule]:
    """Learn from labelled rows that pass the base checks, which decide before the list does."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).cast("long").alias("id_")).agg((F.min(label_col) <= 0).alias("bad_"))
    rows = bounded(stats.where(~base_failed()).join(known, "id_"), "id_", most_rows, *STATISTICS)
    rows = rows.select("bad_", *STATISTICS).toPandas()
    bad = rows["bad_"].to_numpy(bool)
    return learn(rows, bad, **options) if bad.any() and not bad.all() else []


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: id, STATISTICS, base_failed, kept."""
    stats = scratch.keep(text_statistics(docs, id_col, text_col), "rules-statistics", batch_rows=2000)
    rules = fit(stats, labels, id_col, **options)
    out = stats.select(F.col("id_").alias(id_col), *STATISTICS, base_failed().alias("base_failed"), verdict(rules).alias("listed_"))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("listed_")).drop("listed_")
