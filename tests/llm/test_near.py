import random

import pytest

import corpus_pipeline
from eventlake.llm import simhash

DOCS = "doc_id long, text string"


def _jaccard(a, b, size=5):
    a, b = ({" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} for w in ((a or "").lower().split(), (b or "").lower().split()))
    return len(a & b) / len(a | b)


def _kept(rows, least=0.8):
    """Ids that stay, by comparing all pairs."""
    root = list(range(len(rows)))

    def find(i):
        return i if root[i] == i else find(root[i])

    for i in range(len(rows)):
        for j in range(i):
            if _jaccard(rows[i][1], rows[j][1]) >= least:
                root[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return sorted(min(g) for g in groups.values())


def _edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**9)}"
    return words


def _rows(seed=5, texts=40):
    """Texts with copies of several edited words or an added paragraph, about half of them at 0.8 or more."""
    rng = random.Random(seed)
    out = []
    for _ in range(texts):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([150, 300]))]
        out.append(" ".join(base))
        for _ in range(3):
            edits = rng.choice([1, 2, 3, 5, 8])
            out.append(" ".join(_edited(rng, base, edits)))
        out.append(" ".join(base + [f"p{rng.randrange(5000)}" for _ in range(len(base) // 6)]).upper())
    out += ["", None, " \n", "one two", "ONE  two", "one two three"]
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("crowd", [2048, 2])
def test_near_copies_against_all_pairs(spark, crowd):
    rows = _rows()
    got = simhash.keep_similar(spark.createDataFrame(rows, DOCS), crowd=crowd).collect()
    assert sorted(r.doc_id for r in got) == _kept(rows)


def test_stage_drops_edited_copies(spark):
    rng = random.Random(1)
    base = [f"w{rng.randrange(5000)}" for _ in range(600)]
    rows = [(0, " ".join(base)), (1, " ".join(_edited(rng, base, 6))), (2, " ".join(base + [f"p{i}" for i in range(100)])), (3, " ".join(rng.sample(base, 600)))]
    assert _jaccard(rows[0][1], rows[1][1]) >= 0.8 and _jaccard(rows[0][1], rows[2][1]) >= 0.8
    out = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, DOCS), "")
    assert sorted(r.doc_id for r in out.collect()) == [0, 3]


def test_one_large_group(spark):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(_edited(rng, base, 1))) for i in range(300)]
    assert [r.doc_id for r in simhash.keep_similar(spark.createDataFrame(rows, DOCS).repartition(5), crowd=32).collect()] == [0]
