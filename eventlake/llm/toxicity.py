"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier on the words of a text is trained in numpy from texts confirmed as toxic and
texts of which nothing is known.  With the class prior p, the risk of calling unlabelled texts
clean is corrected for the toxic ones among them,

    p * R(toxic called toxic) + max(0, R(unlabelled called clean) - p * R(toxic called clean)),

and where the corrected part turns negative, the step is taken against it, so that the model does
not fit the unlabelled texts one by one.  Unlabelled texts are any texts outside the held-out fold;
whether one has a label is not looked at, so they are distributed as all texts are, which is what
the correction supposes.  p is a parameter; unless given it is the toxic share of the labels learned
from, or ``PRIOR`` where those are of one kind.

Features are words and their beginnings of 4 to 6 letters (texts inflect and join words).  The texts
fitted to propose them; those enriched in toxic texts and the most frequent others are chosen by their
counts over all unlabelled texts.  The score is a logistic function of the classifier; where there are clean labels it is
shifted and scaled on labelled rows of the learning fold, else shifted so that the share p of the
unlabelled texts gets 0.5 or more.

Bounds: the risk is that of at most ``most_toxic`` toxic and ``most_unlabelled`` unlabelled rows, the scale that of at
most ``most_clean`` clean ones, all chosen by a hash of the id; ``most_features`` bounds the model.  Counts of
features are over all texts.  Every text is scored, and whole.

Defined results: null and empty texts have no words and get the score of the bias.  Without a toxic
label every score is ``prior``, or 0 if that is not given.  Several labels of one id count once, as
toxic if one is; labels of unknown and null ids are ignored.  Repeated rows get equal scores, and
equal texts do.  An empty table gives an empty result.  Other columns are not read, whatever their
names; ``keep_clean`` keeps all of them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Collection, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlake.llm.memory import released
from eventlake.llm.sample import bounded
from eventlake.plans import scratch

_WORD = re.compile(r"[^\W\d_]+")
_STEMS = (4, 5, 6)
PRIOR = 0.05


def held_out(id_: Column, folds: int = 5) -> Column:
    """True for the fold that labels are never learned from."""
    return F.pmod(F.crc32(F.encode(F.coalesce(id_.cast("string"), F.lit("")), "UTF-8")), F.lit(folds)) == 0


def distinct_words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def parts(words: set[str]) -> Iterator[tuple[str, set[str]]]:
    """(kind, strings): the words, then the beginnings of each length; a feature is a kind and a string."""
    yield "0", words
    for k in _STEMS:
        yield str(k), {w[:k] for w in words if len(w) > k}


def _tables(features: Collection[str]) -> dict[str, set[str]]:
    """The strings of each kind."""
    found: dict[str, set[str]] = {kind: set() for kind, _ in parts(set())}
    for f in features:
        found[f[0]].add(f[1:])
    return found


@dataclass
class Model:
    """weights: by feature; a text's logit is bias plus the weights of the features it has."""

    bias: float
    weights: dict[str, float] = field(default_factory=dict)

    def scores(self, texts) -> np.ndarray:
        out, weights, tables = np.empty(len(texts)), self.weights, _tables(self.weights)
        for i, text in enumerate(texts):
            hits = [weights[kind + x] for kind, some in parts(distinct_words(text)) for x in some & tables[kind]]
            out[i] = self.bias + math.fsum(hits)
        return _logistic(out)


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def risk(w: np.ndarray, b: float, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float]:
    """(the part that is always there, the corrected part before it is cut at 0)."""
    z_p, z_u = positive @ w + b, unlabelled @ w + b
    return prior * np.logaddexp(0, -z_p).mean(), np.logaddexp(0, z_u).mean() - prior * np.logaddexp(0, z_p).mean()


def gradient(w: np.ndarray, b: float, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> np.ndarray:
    """Of the risk by w and b; where the corrected part is negative, of that part with its sign turned."""
    z_p, z_u = positive @ w + b, unlabelled @ w + b
    s_p, s_u = _logistic(z_p), _logistic(z_u)
    clean = np.logaddexp(0, z_u).mean() - prior * np.logaddexp(0, z_p).mean()
    g_p, g_u = -prior * s_p / len(z_p), s_u / len(z_u)  # of the corrected part
    g_p, g_u = (g_p + prior * (s_p - 1) / len(z_p), g_u) if clean >= 0 else (-g_p, -g_u)
    kind = positive.dtype  # the matrices are not copied to a wider type
    return np.append(g_p.astype(kind) @ positive + g_u.astype(kind) @ unlabelled, g_p.sum() + g_u.sum())


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = 400, rate: float = 0.05, decay: float = 2e-3) -> tuple[np.ndarray, float]:
    """(weights, bias) of the linear classifier that minimises the non-negative corrected risk."""
    w, b = np.zeros(positive.shape[1], np.float32), -1.0
    m, v = np.zeros(len(w) + 1, np.float32), np.zeros(len(w) + 1, np.float32)
    for t in range(1, rounds + 1):
        grad = gradient(w, b, positive, unlabelled, prior).astype(np.float32)
        grad[:-1] += decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = (w - step[:-1]).astype(np.float32), float(b - step[-1])
    return w.astype(np.float64), b


def feature_counts(texts: DataFrame, features: Collection[str]) -> DataFrame:
    """(feature, n): in how many rows of ``texts`` (text_) each of the features is; tasks count before they send anything."""
    tables = _tables(features)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for kind, some in parts(distinct_words(text)):
                    held.update([kind + x for x in some & tables[kind]])
        names = [x.encode("utf-8", "surrogatepass") for x in held]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(list(held.values()), pa.int64())], names=["feature", "n"])

    counted = texts.select(F.coalesce("text_", F.lit("")).alias("text_")).mapInArrow(released(run), "feature binary, n long")
    return counted.groupBy(F.decode("feature", "UTF-8").alias("feature")).agg(F.sum("n").alias("n"))


def _numbered(samples: list[list[str]]) -> tuple[list[list[np.ndarray]], list[str]]:
    """Texts (words with line feeds between) as numbers of features, and the features."""
    names: dict[str, int] = {}

    def numbers(text: str) -> np.ndarray:
        words = set(text.split("\n")) - {""}
        return np.array([names.setdefault(kind + x, len(names)) for kind, some in parts(words) for x in sorted(some)], np.uint32)

    return [[numbers(text) for text in texts] for texts in samples], list(names)


def _proposed(positive: list[np.ndarray], unlabelled: list[np.ndarray], most: int) -> tuple[dict[int, int], list[int]]:
    """(texts by feature that several toxic texts have, features that are frequent): what is counted over all texts."""
    f_p, n_p = np.unique(np.concatenate(positive), return_counts=True)
    f_u, n_u = np.unique(np.concatenate(unlabelled), return_counts=True)
    often = n_p >= max(2, int(0.005 * len(positive)))
    frequent = f_u[np.argsort(-n_u, kind="stable")[: most // 2]]
    return dict(zip(f_p[often].tolist(), n_p[often].tolist(), strict=True)), frequent.tolist()


def _choose(toxic: dict[str, int], n_toxic: int, counts: dict[str, int], n_texts: int, frequent: list[str], most: int) -> list[str]:
    """Features that are enriched in toxic texts, those most certainly beyond chance first, and the most frequent others."""
    gains = {}
    for f, n in toxic.items():
        share, rest = n / n_toxic, (counts.get(f, 0) + 0.5) / (n_texts + 1)
        if share > 3 * rest:
            gains[f] = n * math.log(share / rest)
    enriched = sorted(gains, key=lambda f: (-gains[f], f))[: most * 7 // 8]
    return sorted({*enriched, *sorted(frequent, key=lambda f: (-counts.get(f, 0), f))[: most // 8]})


def _matrix(texts: list[np.ndarray], places: np.ndarray, width: int) -> np.ndarray:
    """A row of 0 and 1 for each text; ``places`` has the column of each feature's number, or -1."""
    out = np.zeros((len(texts), width), np.float32)
    for i, t in enumerate(texts):
        at = places[t]
        out[i, at[at >= 0]] = 1.0
    return out


def _settle(z: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """(scale, shift) of the logit from labelled rows, by a damped Newton fit."""
    a, c = 1.0, 0.0
    y = np.where(toxic, (toxic.sum() + 1) / (toxic.sum() + 2), 1 / ((~toxic).sum() + 2))
    x = np.column_stack((z, np.ones(len(z))))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + c, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (p - y) + 1e-3 * np.array([a - 1.0, 0.0]))
        step /= max(1.0, np.abs(step).max())
        a, c = max(a - step[0], 0.05), c - step[1]
    return float(a), float(c)


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5,
    prior: float | None = None, most_toxic: int = 2500, most_unlabelled: int = 5000, most_clean: int = 2000, most_features: int = 1024,
) -> Model:
    """Learn from toxic labels outside the held-out fold and from the texts outside it."""
    spark = docs.sparkSession
    fold = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col), folds))
    known = fold.groupBy(F.col(id_col).cast("long").alias("id_")).agg((F.max(label_col) > 0).alias("toxic_"))
    rows = docs.select(F.col(id_col).cast("long").alias("id_"), F.coalesce(F.col(text_col), F.lit("")).alias("text_"))
    rows = rows.where(F.col("id_").isNotNull() & ~held_out(F.col("id_"), folds))
    counts = known.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("toxic_").cast("long")), F.lit(0))).first()
    if prior is None:
        prior = counts[1] / counts[0] if 0 < counts[1] < counts[0] else PRIOR if counts[1] else 0.0
    edge = np.clip(prior, 1e-9, 1 - 1e-9)
    constant = Model(float(np.log(edge / (1 - edge))))

    def some(rows: DataFrame, most: int, role: int) -> DataFrame:
        return bounded(rows, "id_", most).select("id_", F.lit(role).alias("role_"))

    ids = rows.select("id_").distinct()
    # The bounds make these at most most_toxic + most_unlabelled + most_clean rows; a text may have two roles.
    present = known.join(ids, "id_", "left_semi")
    chosen = some(present.where("toxic_"), most_toxic, 2).unionByName(some(ids, most_unlabelled, 1)).unionByName(some(present.where("not toxic_"), most_clean, 0))
    chosen = chosen.toPandas()
    if not (chosen["role_"] == 2).any():
        return constant
    chosen = spark.createDataFrame(chosen, "id_ long, role_ int")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = ["\n".join(sorted(distinct_words(t))).encode("utf-8", "surrogatepass") for t in batch["text_"]]
            yield pd.DataFrame({"id_": batch["id_"], "role_": batch["role_"], "words": sets})

    with scratch.batches_of(spark, 2000):
        sample = rows.join(F.broadcast(chosen), "id_").mapInPandas(released(run), "id_ long, role_ int, words binary").toPandas()
    sample = sample.sort_values(["id_", "role_", "words"], kind="stable").drop_duplicates(["id_", "role_"])
    of_role = [[x.decode("utf-8", "surrogatepass") for x in sample.loc[sample["role_"] == r, "words"]] for r in (2, 1, 0)]
    (toxic, any_, clean), names = _numbered(of_role)
    several, frequent = _proposed(toxic, any_, most_features)
    proposed = {names[f] for f in (*several, *frequent)}
    counted = scratch.keep(feature_counts(rows, proposed), "toxicity-counts", batch_rows=2000)
    counts = {r["feature"]: r["n"] for r in counted.collect()}  # of what the bounded sample proposes
    features = _choose({names[f]: n for f, n in several.items()}, len(toxic), counts, rows.count(), [names[f] for f in frequent], most_features)
    at, places = {f: i for i, f in enumerate(features)}, np.full(len(names), -1)
    for i, name in enumerate(names):
        places[i] = at.get(name, -1)
    positive, unlabelled = _matrix(toxic, places, len(features)), _matrix(any_, places, len(features))
    weights, bias = fit_nnpu(positive, unlabelled, prior)
    scale, shift = 1.0, 0.0
    if clean:
        z = np.concatenate((positive @ weights, _matrix(clean, places, len(features)) @ weights)) + bias
        scale, shift = _settle(z, np.arange(len(z)) < len(positive))
    else:  # as many of the unlabelled texts are toxic as the prior says
        shift = -float(np.quantile(unlabelled @ weights + bias, 1 - prior, method="midpoint"))
    used = np.abs(weights) > 1e-6
    return Model(scale * bias + shift, {f: float(scale * w) for f, w, use in zip(features, weights, used, strict=True) if use})


def score(text: Column, model: Model) -> Column:
    """The score of each whole text, 0 to 1."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from released(lambda some: (pd.Series(model.scores(texts)) for texts in some))(batches)

    return scored(F.coalesce(text, F.lit("")))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, **options) -> DataFrame:
    """One row per document: id, held_out, score, predicted."""
    model = train(docs, labels, id_col, text_col, folds=folds, **options)
    scored = docs.select(F.col(id_col), held_out(F.col(id_col), folds).alias("held_out"), score(F.col(text_col), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are not predicted to be toxic, with all their columns."""
    model = train(docs, labels, id_col, text_col, **options)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_"), score(F.col(text_col), model).alias("score_"))
    return packed.where(F.col("score_") < 0.5).select("row_.*")
