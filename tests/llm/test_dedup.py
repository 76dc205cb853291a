import random

import pytest
from pyspark.sql import types as T

from eventlake.llm import exact_dedup, simhash
from eventlake.llm.components import components
from tests.llm import brute

DOCS = "doc_id long, text string"


def _texts(n=120, seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    base = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 40, 80]))) for _ in range(n // 4)]
    rows = []
    for i in range(n):
        t = rng.choice(base)
        t = rng.choice([t, t.replace(" ", "  "), t.replace(" ", "\t"), t + "\n", t + " x", t.upper()])
        rows.append((i, t))
    rows += [(n, None), (n + 1, ""), (n + 2, " \t"), (None, base[0]), (None, None), (5, rows[5][1]), (5, rows[5][1]), (n + 3, "a" * 150_000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("hex_digits", [64, 1])  # 1: all digests collide, only contents tell texts apart
@pytest.mark.parametrize("hot_share", [1000, 4])
def test_exact_groups(spark, hex_digits, hot_share):
    rows = _texts()
    want = brute.exact_groups(rows)
    got = exact_dedup.exact_groups(spark.createDataFrame(rows, DOCS), hot_share=hot_share, salts=3, hex_digits=hex_digits).collect()
    key = lambda id_, keep, size: (str(id_), str(keep), size)
    assert sorted(key(r.doc_id, r.keep_id, r.group_size) for r in got) == sorted(key(rows[i][0], w[0], w[1]) for i, w in want.items())
    if hex_digits == 64:
        assert sorted(r.text_sha256 for r in got) == sorted(w[2] for w in want.values())
    assert sum(r.kept for r in got) == len({w[2] for w in want.values()})
    assert all(r.kept is False or r.doc_id == r.keep_id for r in got)


def test_exact_hot_group(spark):
    rows = [(i, "same text" if i % 3 else f"text {i}") for i in range(900)]
    got = {r.doc_id: r for r in exact_dedup.exact_groups(spark.createDataFrame(rows, DOCS).repartition(7)).collect()}
    assert got[1].kept and got[1].group_size == 600 and all(got[i].keep_id == 1 for i in range(900) if i % 3)


def test_exact_keep_one_keeps_columns(spark):
    schema = T.StructType([T.StructField(c, T.LongType() if c == "doc_id" else T.StringType()) for c in ("doc_id", "text", "digest_", "row_", "kept", "keep_id")])
    rows = [(1, "a b", "p", "q", "r", "s"), (2, "ab", "p", "q", "r", "s"), (3, None, None, None, None, None), (1, "a b", "p", "q", "r", "s"), (None, "z", "", "", "", "")]
    out = exact_dedup.keep_one(spark.createDataFrame(rows, schema))
    assert out.columns == schema.names
    assert sorted(out.collect(), key=str) == sorted([rows[0], rows[2], rows[4]], key=str)


def test_exact_empty(spark):
    assert exact_dedup.exact_groups(spark.createDataFrame([], DOCS)).count() == 0
    assert exact_dedup.keep_one(spark.createDataFrame([], DOCS)).count() == 0


def test_fingerprints():
    for text in [None, "", " \t\n", "One", "one two", "A b C", "ÄB c d e ä", "x " * 20_000, "a\x1cb c\x85d e", " lead and trail ", "😀 b c d"]:
        assert simhash.fingerprint(text) == brute.fingerprint(text)


def _near(seed=1):
    rng = random.Random(seed)
    words = [f"v{i}" for i in range(400)]
    rows = []
    for i in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([5, 60, 200]))]
        for k in range(rng.choice([1, 2, 6])):
            t = list(base)
            for _ in range(k):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((1000 - len(rows), " ".join(t)))
    return [*rows, (1, None), (2, ""), (3, "  "), (None, "v1 v2"), (rows[0][0], rows[0][1])]


@pytest.mark.parametrize("crowd", [512, 2])  # 2: nearly every block is crowded
def test_near_groups(spark, crowd):
    rows = _near()
    prints = [brute.fingerprint(t) for _, t in rows]
    roots = brute.components(prints)
    least = {}
    for (id_, _), root in zip(rows, roots, strict=True):
        if id_ is not None:
            least[root] = min(id_, least.get(root, id_))
    want = sorted((str(id_), f"{p:016x}", str(least.get(r))) for (id_, _), p, r in zip(rows, prints, roots, strict=True))
    got = simhash.near_groups(spark.createDataFrame(rows, DOCS), crowd=crowd).collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want


@pytest.mark.parametrize("crowd", [512, 40])
def test_links_keep_every_close_pair_connected(spark, crowd):
    """Fingerprints that crowd around a centre, where chains are long and blocks large."""
    rng = random.Random(9)
    prints = {0, (1 << 64) - 1}
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(60):
            p = centre
            for _ in range(rng.randint(0, 5)):
                p ^= 1 << rng.randrange(64)
            prints.add(p)
    prints = sorted(prints)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    frame = spark.createDataFrame(signed, "fp_ long")
    found = {r.node: r.root for r in components(simhash.links(frame, crowd=crowd)).collect()}
    roots = brute.components(prints)
    groups, want = {}, {}
    for (p,), r in zip(signed, roots, strict=True):
        groups.setdefault(found.get(p, p), set()).add(p)
        want.setdefault(r, set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_near_keep_one(spark):
    rows = [(4, "a b c d e f", 0), (2, "a b c d e f", 1), (9, "other words here now", 2), (2, "a b c d e f", 3), (None, "more of it all", 4)]
    rows += [(2, "the same id with quite another text", 5), (4, "only under this id and repeated", 6), (4, "only under this id and repeated", 6)]
    out = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, component_id long"))
    assert out.columns == ["doc_id", "text", "component_id"]
    assert sorted((str(r.doc_id), r.text) for r in out.collect()) == sorted(
        [("2", rows[0][1]), ("9", rows[2][1]), ("None", rows[4][1]), ("2", rows[5][1]), ("4", rows[6][1])]
    )
    assert simhash.near_groups(spark.createDataFrame([], DOCS)).count() == 0
    assert simhash.keep_one(spark.createDataFrame([], DOCS)).count() == 0


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame([*chain, *star, (7, 7), (0, 1), (-5, 1300), (-5, 1299)], "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[1000 + i] == -5 for i in range(301) if i in (0, 299, 300))
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
