import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from eventlake.llm import packing, token_scan
from eventlake.llm.tokens import WordTokenizer, default_path

DOCS = "doc_id long, text string"
TOKENIZER = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def _ids(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 1]


def _docs(seed=2, n=80):
    rng = random.Random(seed)
    words = "alpha Beta gamma, delta's (epsilon) zeta. eta42 théta ιώτα 漢字 don't!! a-b".split()
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 30, 200])))) for i in range(n)]
    return [*rows, (n, None), (n + 1, ""), (3, rows[3][1]), (None, "x y"), (n + 2, "word, " * 3000), (n + 3, "z" * 3000)]


def test_words_are_encoded_as_whole_texts():
    own = WordTokenizer(default_path(), entries=50)
    texts = [t for _, t in _docs()] + ["I'm we've 'tis x's <|endoftext|> a<|endoftext|>b", "İx ΣΑΣ ßẞ", "a\tb\x0bc\x85d　e", ", . ,. a,b ,a"]
    for text in texts:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == _ids(text)[:-1]


def test_other_tokenizers_get_whole_texts(tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, plain = WordTokenizer(path), Tokenizer.from_file(path)
    assert WordTokenizer(default_path()).by_words and not own.by_words
    for text in [t for _, t in _docs() if t] + ["A  B\n\nc, D.  e", "I'm we've"]:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
    assert own.encode(None) == b""


@pytest.mark.parametrize("window", [64, 2048])
def test_every_id_is_in_one_piece(spark, window):
    rows = _docs()
    pieces = packing.pack(spark.createDataFrame(rows, DOCS).repartition(3), window=window).collect()
    want = defaultdict(list)
    for id_, text in rows:
        want[id_].append(_ids(text))
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
    assert set(by_doc) == set(want)
    for id_, found in by_doc.items():
        ids, copies = want[id_][0], len(want[id_])
        assert sorted(i for p in found for i in range(p.start, p.start + p.length)) == sorted(list(range(len(ids))) * copies)
        for p in found:
            assert p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    short = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
        short += at < window
    assert short <= 1


def test_fill_is_closest_to_capacity():
    rng = random.Random(5)
    for _ in range(200):
        counts = {rng.randint(1, 40): rng.randint(1, 3) for _ in range(rng.randint(1, 6))}
        got = packing.fill(counts, 60)
        assert all(n <= counts[k] for k, n in got.items()) and max(counts) in got
        items = [k for k, n in counts.items() for _ in range(n)]
        items.remove(max(counts))
        sums = {0}
        for x in items:
            sums |= {s + x for s in sums}
        assert sum(k * n for k, n in got.items()) == max(s for s in sums if s <= 60 - max(counts)) + max(counts)


def test_plan_of_one_hot_length():
    rows, sequences = packing.plan({1500: 1_000_000, 7: 3}, 2048)
    assert sequences == -(-(1500 * 1_000_000 + 21) // 2048) and len(rows) < 500


def test_packing_of_nothing(spark):
    assert packing.pack(spark.createDataFrame([], DOCS)).count() == 0
    other = spark.createDataFrame([(1, "a", 5, "s")], "doc_id long, text string, offset long, part_ string")
    assert [r.length for r in packing.pack(other).collect()] == [2]


def test_token_counts(spark):
    rows = _docs()
    got = token_scan.count_tokens(spark.createDataFrame(rows, DOCS).repartition(3))
    assert sorted((str(r.doc_id), r.n_tokens) for r in got.collect()) == sorted((str(i), len(_ids(t)) - 1) for i, t in rows)
    assert token_scan.count_tokens(spark.createDataFrame([], DOCS)).count() == 0


def test_scans_are_dealt_over_tasks(spark, tmp_path):
    """Few small rows stand for much work: they are not merged into one task."""
    from eventlake.llm.spread import spread

    (tmp_path / "f").write_bytes(np.array([1, 2, 9] * 2000, "<u2").tobytes())
    files = token_scan.listing(spark, str(tmp_path))
    rows = token_scan.scan(files, str(tmp_path), 9, 2, 100)
    assert rows.count() == 2000 and rows.agg({"n_tokens": "sum"}).first()[0] == 4000
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    assert spread(spark.range(60)).rdd.getNumPartitions() >= 8 and spread(spark.range(6400)).rdd.getNumPartitions() == 100
    assert spread(spark.range(0)).count() == 0


def test_token_counts_of_a_clashing_id_column(spark):
    got = token_scan.count_tokens(spark.createDataFrame([(5, "a b"), ((1 << 63) - 1, "c"), (None, "")], "file long, text string"), id_col="file")
    assert sorted((str(r.file), r.n_tokens) for r in got.collect()) == [("5", 2), (str((1 << 63) - 1), 1), ("None", 0)]


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_scan_stitches_blocks(spark, tmp_path, block):
    rng, end, want = random.Random(block), 9, []
    for f in range(4):
        ids = [rng.choice([1, 2, 9] if f else [1, 2]) for _ in range(rng.choice([0, 1, 40]) if f else 25)]
        (tmp_path / f"f{f}").write_bytes(np.array(ids, "<u2").tobytes())
        start, ordinal = 0, 0
        for i, x in enumerate(ids):
            if x == end:
                want.append((f"f{f}", ordinal, start, i - start, True))
                start, ordinal = i + 1, ordinal + 1
        if start < len(ids):
            want.append((f"f{f}", ordinal, start, len(ids) - start, False))
    files = token_scan.listing(spark, str(tmp_path))
    assert sorted(map(tuple, token_scan.scan(files, str(tmp_path), end, 2, block).collect())) == sorted(want)
