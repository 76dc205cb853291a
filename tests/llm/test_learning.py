import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from eventlake.llm import mixing, rules, sharding, toxicity
from tests.llm import brute

WORDS = [f"{a}{b}" for a in "bcdfgklmnprst" for b in ("alo", "eni", "ora", "umi", "iste", "ante")]
BAD = ["grok", "snarf", "vexing"]


def _corpus(n=600, seed=0):
    """Documents, and labels of some: one in eight is toxic (bad words), one in six of low quality (symbols)."""
    rng, docs, labels = random.Random(seed), [], []
    for i in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randint(55, 150))]
        toxic, low = rng.random() < 1 / 8, rng.random() < 1 / 6
        if toxic:
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(BAD) + rng.choice(["", "ed", ","])
        if low:
            words = [w + rng.choice(["###", "$$$"]) for w in words]
        docs.append((i, " ".join(words), "en", "s", 0))
        if rng.random() < 0.7:
            labels.append((i, int(not low), int(toxic)))
        docs[-1] += (toxic, low)
    return docs, labels


EXTRA = [(10_000, None), (10_001, ""), (10_002, " \t"), (10_003, "x " * 60_000), (None, "one two"), (0, "repeated id")]


@pytest.fixture(scope="module")
def corpus(spark):
    docs, labels = _corpus()
    frame = spark.createDataFrame([d[:2] for d in docs] + EXTRA, "doc_id long, text string")
    table = spark.createDataFrame([*labels, (None, 1, 1), (77_777, 0, 1), (3, None, None), labels[0]], "doc_id long, quality int, toxic int")
    return docs, frame.repartition(3), table


def test_toxicity(spark, corpus):
    docs, frame, labels = corpus
    got = toxicity.classify(frame, labels).collect()
    assert len(got) == len(docs) + len(EXTRA) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0) for r in got)
    truth = {d[0]: d[5] for d in docs}
    held = [(truth[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in truth]
    hits = Counter(held)
    assert hits[True, 1] >= 0.9 * (hits[True, 1] + hits[True, 0]) and hits[False, 1] <= 2


def test_toxicity_learns_nothing_from_the_held_out_fold(spark, corpus):
    _, frame, labels = corpus
    from pyspark.sql import functions as F

    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.train(frame, labels), toxicity.train(frame, flipped)
    assert a.bias == b.bias and a.weights == b.weights


def test_toxicity_edges(spark, corpus):
    _, frame, labels = corpus
    none = labels.limit(0)
    assert {r.predicted for r in toxicity.classify(frame, none).collect()} == {0}
    assert toxicity.classify(frame.limit(0), labels).count() == 0
    kept = toxicity.keep_clean(frame.selectExpr("doc_id", "text", "1 as score", "2 as row_"), labels)
    assert kept.columns == ["doc_id", "text", "score", "row_"] and 500 < kept.count() < 560


def test_toxicity_from_toxic_labels_alone(spark, corpus):
    """Positive and unlabelled texts and a prior are enough."""
    docs, frame, labels = corpus
    truth = {d[0]: d[5] for d in docs}
    for prior in (None, 0.125):
        got = toxicity.classify(frame, labels.where("toxic = 1"), prior=prior).where("held_out").collect()
        ranked = sorted((r for r in got if r.doc_id in truth), key=lambda r: -r.score)
        toxic = sum(truth[r.doc_id] for r in ranked)
        assert sum(truth[r.doc_id] for r in ranked[:toxic]) >= 0.9 * toxic > 5
        if prior:
            assert sum(truth[r.doc_id] for r in ranked if r.predicted) >= 0.6 * toxic and sum(not truth[r.doc_id] for r in ranked if r.predicted) <= 4


def test_feature_counts_are_over_all_texts(spark):
    texts = [None, "", "Bad bad words", "words, wordy wordings", "é 12 bad"] * 3
    every = {"0bad", "0words", "4word", "5wordi", "6wordin", "0é", "0none", "4none"}
    got = {r.feature: r.n for r in toxicity.feature_counts(spark.createDataFrame([(t,) for t in texts], "text_ string").repartition(2), every).collect()}
    assert got == {"0bad": 6, "0words": 6, "4word": 6, "5wordi": 3, "6wordin": 3, "0é": 3}
    model = toxicity.Model(-1.0, {"0bad": 0.5, "4word": 2.0, "6wordin": 1.0})
    want = [-1, -1, 1.5, 2, -0.5]
    assert model.scores(texts[:5]) == pytest.approx([1 / (1 + np.exp(-z)) for z in want])


@pytest.mark.parametrize("shift", [-3.0, 0.0, 3.0])  # the corrected part is negative for the first
def test_gradient_is_that_of_the_risk(shift):
    rng = np.random.default_rng(1)
    positive, unlabelled, w, prior = rng.random((30, 8)), rng.random((50, 8)), rng.normal(size=8), 0.4
    if shift < 0:
        positive = positive + 2 * (w > 0)
    first, second = toxicity.risk(w, shift, positive, unlabelled, prior)
    assert (second < 0) == (shift < 0)
    value = lambda w, b: sum(toxicity.risk(w, b, positive, unlabelled, prior)) if second >= 0 else -toxicity.risk(w, b, positive, unlabelled, prior)[1]
    e = 1e-6
    want = [(value(w + e * d, shift) - value(w - e * d, shift)) / (2 * e) for d in np.eye(8)] + [(value(w, shift + e) - value(w, shift - e)) / (2 * e)]
    assert toxicity.gradient(w, shift, positive, unlabelled, prior) == pytest.approx(np.array(want), abs=1e-7)


def test_nonnegative_risk():
    """Few positives, many features: the corrected risk must not let unlabelled texts be learned by heart."""
    rng = np.random.default_rng(0)
    signal = rng.random(1200) < 0.2
    x = (rng.random((1200, 60)) < 0.3).astype(np.float32)
    x[:, 0] = signal
    w, b = toxicity.fit_nnpu(x[signal][:40], x[240:], 0.2)
    z = x @ w + b
    assert ((z > 0) == signal).mean() > 0.9 and w[0] > 2 * np.abs(w[1:]).max()


def test_statistics():
    texts = [None, "", " \n", "a b c a b c", "x\nx\n\n\n x\nx", "# *$% & | <>", "a b c d\na b c d", "aa aa aa aa", "é ü\x1cß\x85 k", "a\tb\x0bc\x0cd\re", "w " * 5000]
    rng = random.Random(1)
    texts += [" ".join(rng.choice("abcd") for _ in range(rng.randint(1, 40))).replace("a b", "a\nb") for _ in range(60)]
    for text in texts:
        assert rules.statistics(text) == brute.statistics(text)


def test_quality_rules(spark, corpus):
    docs, frame, labels = corpus
    got = rules.judge(frame, labels).collect()
    assert len(got) == len(docs) + len(EXTRA)
    texts = Counter(brute.statistics(t) for _, t in [d[:2] for d in docs] + EXTRA)
    assert Counter((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == texts
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    truth = {d[0]: d[6] for d in docs}
    wrong = [r for r in got if r.doc_id in truth and r.doc_id and not r.base_failed and r.kept == truth[r.doc_id]]
    assert len(wrong) <= 6
    assert rules.judge(frame, labels.limit(0)).where("kept = base_failed").count() == 0
    assert rules.judge(frame.limit(0), labels).count() == 0


def test_rules_are_expressions_that_agree_with_the_learner(spark):
    rng = np.random.default_rng(2)
    rows = pd.DataFrame({s: rng.integers(0, 300, 400) for s in rules.STATISTICS})
    bad = ((rows["n_symbols"] > 2 * rows["n_words"]) & (rows["n_words"] > 40) | (rows["n_words"] > 280)).to_numpy()
    learned = rules.learn(rows, bad)
    assert learned and "reject if" in str(learned[0])
    values = rules._measures(rows)
    want = ~np.logical_or.reduce([r.covers(values) for r in learned])
    got = spark.createDataFrame(rows.assign(at=range(400))).withColumn("k", rules.verdict(learned)).orderBy("at").toPandas()["k"].to_numpy()
    assert (got == want).all() and (want == ~bad).mean() > 0.95


def test_mixing(spark, corpus):
    docs, frame, labels = corpus
    targets = {"high": 0.5, "low": 0.3, "toxic": 0.2}
    got = mixing.weigh(frame, mixing.label_domains(labels), targets).collect()
    assert len(got) == len(docs) + len(EXTRA) and all(0 <= r.rate <= 8 for r in got)
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter((i, brute.statistics(t)[0]) for i, t in [d[:2] for d in docs] + EXTRA)
    total = sum(r.n_tokens for r in got)
    for d, share in targets.items():
        assert sum(r.rate * r.n_tokens * r[f"p_{d}"] for r in got) / total == pytest.approx(share, abs=1e-5)
    report = mixing.shares(mixing.weigh(frame, mixing.label_domains(labels), targets), targets).collect()
    assert {r.domain: r.target for r in report} == targets and max(abs(r.gap) for r in report) < 1e-5
    truth = {d[0]: "toxic" if d[5] else "low" if d[6] else "high" for d in docs if d[0]}
    guess = {r.doc_id: max(targets, key=lambda d, r=r: r[f"p_{d}"]) for r in got if r.doc_id in truth}
    assert sum(guess[i] == t for i, t in truth.items()) > 0.9 * len(truth)


def _least_squares(p, w, want, low, high, rounds=60_000):
    """Rates by an accelerated projected gradient on the rates themselves, nothing else in common with the operator."""
    a = p * (w / w.sum())[:, None]
    step, r, t = 1 / np.linalg.norm(a, 2) ** 2, np.ones(len(w)), 1.0
    y = r
    for _ in range(rounds):
        new = np.clip(y - step * (a @ (a.T @ y - want)), low, high)
        later = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, r, t = new + (t - 1) / later * (new - r), new, later
    return a.T @ r - want


def test_mixing_is_least_squares(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(0)
    p = rng.dirichlet([0.3, 0.3, 0.3], 300)
    w = rng.integers(1, 500, 300)
    members = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(w, p, strict=True)], "tokens_ long, p_ array<double>").coalesce(1)
    for want, high in (([0.45, 0.35, 0.2], 2.0), ([0.9, 0.05, 0.05], 8.0), ([0.1, 0.1, 0.8], 8.0), ([0.01, 0.01, 0.98], 8.0), ([0.1, 0.1, 0.8], 2.0)):
        fit = mixing.fit_rates(members, want, F.lit(0.0), high)
        gaps = _least_squares(p, w, np.array(want), 0, high)
        assert fit.settled and fit.rounds < 60
        if np.abs(gaps).max() < 1e-6:  # within reach
            assert np.abs(fit.gaps).max() < 1e-5
        assert (np.square(fit.gaps).sum()) <= np.square(gaps).sum() * 1.001 + 1e-10
        got = members.select("tokens_", "p_", mixing._rate(fit.sums, F.col("p_"), F.lit(0.0), high).alias("r")).collect()
        share = sum(np.array(r.p_) * r.tokens_ * r.r for r in got) / w.sum()
        assert share - np.array(want) == pytest.approx(np.array(fit.gaps), abs=1e-9)


def test_mixing_of_six_domains_and_of_thinning(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(5)
    p = rng.dirichlet([0.2] * 6, 400)
    w = rng.integers(0, 500, 400)
    members = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(w, p, strict=True)], "tokens_ long, p_ array<double>").coalesce(1)
    want = [0.3, 0.25, 0.2, 0.15, 0.07, 0.03]
    assert np.abs(mixing.fit_rates(members, want, F.lit(0.0), 8.0).gaps).max() < 1e-5
    fit = mixing.fit_rates(members, want, F.lit(0.0), 1.0)  # shares of what stays
    rates = [r[0] for r in members.select(mixing._rate(fit.sums, mixing._feature(want, 1.0), F.lit(0.0), 1.0)).collect()]
    kept = (p * (w * rates)[:, None]).sum(0)
    assert max(rates) <= 1 and kept / kept.sum() == pytest.approx(np.array(want), abs=1e-4) and kept.sum() > 0.2 * w.sum()


def test_mixing_edges(spark, corpus):
    docs, frame, labels = corpus
    domains = mixing.label_domains(labels)
    assert mixing.weigh(frame.limit(0), domains, {"high": 1.0, "low": 1.0}).count() == 0
    even = mixing.weigh(frame, domains.limit(0), {"high": 1.0, "low": 1.0}).collect()
    assert all(r.rate == pytest.approx(1.0) for r in even)
    kept = mixing.thin(frame.selectExpr("doc_id", "text", "3 as tokens_", "4 as rate"), domains, {"high": 0.97, "low": 0.03}, "high")
    assert kept.columns == ["doc_id", "text", "tokens_", "rate"]
    ids = {r.doc_id for r in kept.collect()}
    truth = {d[0]: d[6] for d in docs if not d[5]}
    assert all(i in ids for i, low in truth.items() if not low)
    assert sum(i in ids for i, low in truth.items() if low) < 0.6 * sum(truth.values())


def test_lookup_table_by_turns():
    """Each shard in turn claims its first free slot, as told slot by slot."""
    shards, weights, size = ["a", "b", "c"], [1, 2, 1], 101
    free, table = set(range(size)), {}
    prefer = {s: [(sharding._hash(s, "offset") % size + k * (sharding._hash(s, "skip") % (size - 1) + 1)) % size for k in range(size)] for s in shards}
    while free:
        for i, s in enumerate(shards):
            for _ in range(weights[i]):
                if free:
                    slot = next(x for x in prefer[s] if x in free)
                    free.remove(slot)
                    table[slot] = i
    assert sharding.lookup_table(shards, size, weights).tolist() == [table[k] for k in range(size)]


def test_sharding(spark):
    shards = [f"s{i}" for i in range(7)]
    rows = spark.createDataFrame([(i, "x", 1) for i in range(3000)] + [(None, "x", 1), (5, "y", 2)], "doc_id long, shard string, slot_ int")
    got = sharding.place(rows, "doc_id", shards, 1009).collect()
    counts = Counter(r.shard for r in got)
    assert len(got) == 3002 and set(counts) == set(shards) and max(counts.values()) < 1.2 * min(counts.values())
    assert len({r.shard for r in got if r.doc_id == 5}) == 1
    import hashlib

    table = sharding.lookup_table(shards, 1009)
    for r in got[:300]:
        slot = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:15], 16) % 1009
        assert (r.shard_slot, r.shard) == (slot, shards[table[slot]])
    before, after = sharding.lookup_table(shards, 1009), sharding.lookup_table(shards[:-1], 1009)
    stay = [b == a for b, a in zip(before, after, strict=True) if b != 6]
    assert sum(stay) > 0.8 * len(stay)
    with pytest.raises(ValueError):
        sharding.lookup_table(shards, 1000)
    assert sharding.place(rows.limit(0), "doc_id", shards, 1009).count() == 0
