"""Near duplicates by SimHash fingerprints and pigeonhole blocks.

By bits (``near_groups``, ``keep_one``).  A 64-bit fingerprint is cut into ``blocks`` blocks.  Those
that differ in at most ``bits`` bits agree in at least ``blocks - bits`` whole blocks, so each is
listed once under every choice of that many blocks, and close pairs meet under at least one of them.
What meets is verified by Hamming distance; each group yields the edges of a spanning forest of its
links, which keeps every link's two ends connected without listing all pairs.  Distinct
fingerprints, not documents, are listed, so copies cost nothing.  A group of more than ``crowd``
fingerprints is not dealt to one task: the bits that its members do not share by their place in it
are cut into blocks again, and only they are listed under the choices of those, until groups are
small or have no more than 2**``_FEW_BITS`` fingerprints by their nature.  No link is lost.

By similarity (``keep_similar``).  Sets of shingles with a Jaccard similarity of 0.8 differ in about
10 of 64 bits of their fingerprints, and in every block.  So a text's fingerprint is ``VIEWS`` blocks
and a whole: a block is the SimHash of a slice, the ``SLICE`` shingles that come first in an order of
its own, the whole the 256-bit SimHash of all shingles.  Differences between texts leave slices
untouched: texts at exactly 0.8 share no block once in 38,000 cases, closer ones less often.  What
shares a block is verified by the Hamming distance of the wholes (a pair at 0.8 exceeds ``_WHOLE_BITS``
about once in 10,000 cases; the second number is for sets of fewer than ``_SMALL`` shingles) and then exactly, by the shingles of both whole texts.  First the texts of
``_FIRST`` views are held against the smallest of their block, which links most of what is alike.
After that only blocks that hold several components count.  In those of at most ``crowd`` texts (and
``_LONG`` shingles) all texts of different components are compared, exactly and in place: no pairs are
listed, only edges that join components.  The texts of larger blocks are held against the smallest
and then listed again under the pairs, then triples of blocks they share, and what is still crowded is
compared so a tile of ``crowd`` by ``crowd`` texts at a time.

Defined results: null and empty texts have no words and the fingerprint zero, which links like any
other; by similarity they are copies of each other.  A text with fewer words than a shingle is one
shingle.  Repeated rows link to each other.  A component whose ids are all null has a null
component_id.  An empty table gives an empty result.  Other columns are not read, whatever their
names; the functions that keep rows keep all columns.  Ids may be any long.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlake.llm.components import components
from eventlake.llm.memory import released
from eventlake.plans import scratch

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_CHUNK = 1 << 14  # counts within it fit 16 bits
_FEW_BITS = 15
_SIEVE = 18
VIEWS, SLICE, _FIRST, _WHOLE_BITS = 20, 4, 4, (61, 80)
_SMALL, _HELD, _LONG = 16, 32 << 20, 1 << 22
_WHOLE = ["w0_", "w1_", "w2_", "w3_"]
_RNG = np.random.default_rng(42)
_ORDERS = _RNG.integers(0, 1 << 63, VIEWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BACK = np.array([pow(int(x), -1, 1 << 64) for x in _ORDERS], np.uint64)


def _hashes(text: str | None, words: int, seed: int) -> Iterator[np.ndarray]:
    """The hashes of a text's shingles, repeats included, in arrays of bounded size; none if it has no words."""
    tokens = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()  # bytes split at \x20 and \x09-\x0D only
    n = len(tokens)
    if not n:
        return
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    count = max(n - words + 1, 1)
    last = ends[words - 1 :] if n >= words else ends[-1:]
    hash_ = xxhash.xxh64_intdigest
    for at in range(0, count, _CHUNK):
        pairs = zip(starts[at : min(at + _CHUNK, count)].tolist(), last[at : at + _CHUNK].tolist(), strict=True)
        yield np.array([hash_(joined[a:b], seed) for a, b in pairs], dtype="<u8")


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits; the last axis but one is summed."""
    return np.unpackbits(hashes[..., None].view(np.uint8), axis=-1, bitorder="little").sum(-2, dtype=np.uint16).astype(np.int64)


def _packed(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=-1, bitorder="little").view("<u8")[..., 0]


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """The unsigned fingerprint of one text."""
    ones, count = np.zeros(64, np.int64), 0
    for hashes in _hashes(text, words, seed):
        ones += _ones(hashes)
        count += len(hashes)
    return int(_packed(2 * ones > count))


def shingles(text: str | None, words: int = 5, seed: int = 42) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; a text without words has the empty shingle."""
    found = list(_hashes(text, words, seed)) or [np.array([xxhash.xxh64_intdigest(b"", seed)], "<u8")]
    return np.unique(np.concatenate(found))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sets of shingles."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _others(hashes: np.ndarray) -> Iterator[np.ndarray]:
    """Each hash, then other 64 bits of it, as often as the whole has numbers."""
    for _ in _WHOLE:
        yield hashes
        for shift, factor in ((33, 0xFF51AFD7ED558CCD), (29, 0xC4CEB9FE1A85EC53)):
            hashes = (hashes ^ (hashes >> np.uint64(shift))) * np.uint64(factor)
        hashes = hashes ^ (hashes >> np.uint64(32))


def sketch(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the whole: four numbers of 64 bits, the blocks: ``VIEWS`` of them) of a set of shingles."""
    ones = np.zeros((len(_WHOLE), 64), np.int64)
    places = np.empty((VIEWS, 0), np.uint64)
    for at in range(0, len(hashes), _CHUNK):
        some = hashes[at : at + _CHUNK]
        ones += np.stack([_ones(x) for x in _others(some)])
        places = np.concatenate((places, some * _ORDERS[:, None]), axis=1)
        if places.shape[1] > SLICE:
            places = np.partition(places, SLICE - 1, axis=1)[:, :SLICE]
    chosen = np.ascontiguousarray(places * _BACK[:, None])  # the factors are odd, so places tell their hashes
    blocks = _packed(2 * _ones(chosen) > chosen.shape[1])
    return _packed(2 * ones > len(hashes)), blocks


def mark(text_col: str):
    """Tells rows of one id apart by their texts."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """(id_, mark_, fp_) for each row; fp_ is the fingerprint as a signed long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            prints = np.fromiter((fingerprint(t, words, seed) for t in batch["text_"]), np.uint64, len(batch))
            yield pd.DataFrame({"id_": batch["id_"], "mark_": batch["mark_"], "fp_": prints.view(np.int64)})

    return _rows(docs, id_col, text_col).mapInPandas(run, "id_ string, mark_ long, fp_ long").withColumn("id_", F.col("id_").cast("long"))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_, mark_, text_) for Python; the id as text, as pandas has no long that may be null."""
    return docs.select(F.col(id_col).cast("long").cast("string").alias("id_"), mark(text_col).alias("mark_"), F.coalesce(F.col(text_col), F.lit("")).alias("text_"))


def _masks(blocks: int, bits: int, known: int = 0) -> list[int]:
    """Masks of every choice of ``blocks - bits`` of the blocks that the bits outside ``known`` are cut into, with ``known``."""
    rest = [1 << i for i in range(64) if not known >> i & 1]
    edges = [round(i * len(rest) / blocks) for i in range(blocks + 1)]
    parts = [sum(rest[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
    return sorted({known | sum(chosen) for chosen in combinations(parts, blocks - bits)})


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _listed(prints: DataFrame, masks: list[int]) -> DataFrame:
    """(mask_, key_, fp_): each fingerprint under every choice of blocks."""
    listed = prints.select("fp_", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask_"))
    return listed.select("mask_", F.col("fp_").bitwiseAND(F.col("mask_")).alias("key_"), "fp_")


def _forest(prints: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links within one block, found a vector at a time."""
    left, edges = prints, []
    while len(left) > 1:  # breadth-first: reached holds what is newly connected
        reached, left = left[:1], left[1:]
        while len(reached) and len(left):
            node, reached = reached[0], reached[1:]
            near = np.bitwise_count((left ^ node).view(np.uint64)) <= bits
            if near.any():
                found = left[near]
                edges.extend((int(node), int(x)) for x in found)
                reached, left = np.concatenate((reached, found)), left[~near]
    return edges


def _verified(listed: DataFrame, bits: int) -> DataFrame:
    """(u, v) edges from the blocks of ``listed``, which are of bounded size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            rest = batch if rest is None else pd.concat((rest, batch), ignore_index=True)
            mask, key = rest["mask_"].to_numpy(), rest["key_"].to_numpy()
            cuts = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
            if not len(cuts):
                continue
            done, rest = rest.iloc[: cuts[-1]], rest.iloc[cuts[-1] :].reset_index(drop=True)
            yield edges_of(done["fp_"].to_numpy(), cuts[:-1])
        if rest is not None:
            yield edges_of(rest["fp_"].to_numpy(), np.array([], np.int64))

    def edges_of(prints: np.ndarray, cuts: np.ndarray) -> pd.DataFrame:
        starts = np.concatenate(([0], cuts))
        ends = np.append(cuts, len(prints))
        edges = []
        for k in np.flatnonzero(ends - starts > 1):
            edges += _forest(prints[starts[k] : ends[k]], bits)
        return pd.DataFrame(edges, columns=["u", "v"], dtype="int64")

    spread = listed.repartition("mask_", "key_").sortWithinPartitions("mask_", "key_", "fp_")
    return spread.mapInPandas(run, "u long, v long")


def links(prints: DataFrame, bits: int = 3, blocks: int = 5, crowd: int = 512) -> DataFrame:
    """Edges (u, v) over distinct fingerprints that connect exactly what links of ``bits`` bits connect."""
    masks = _masks(blocks, bits)
    listed, found = _listed(prints, masks), None
    while True:
        last = max(64 - m.bit_count() for m in masks) <= _FEW_BITS
        crowded = listed.groupBy("mask_", "key_").agg(F.count(F.lit(1)).alias("n_")).where(F.col("n_") > crowd).select("mask_", "key_")
        crowded = None if last else scratch.keep(crowded, "simhash-crowded")
        last = last or not crowded.limit(1).count()
        edges = _verified(listed if last else listed.join(crowded, ["mask_", "key_"], "left_anti"), bits)
        found = edges if found is None else found.unionByName(edges)
        if last:
            return found
        finer = {m: _masks(blocks, bits, m) for m in masks}  # at most 1,000 masks and 10 times as many
        table = listed.sparkSession.createDataFrame([(_signed(m), _signed(x)) for m, some in finer.items() for x in some], "mask_ long, finer_ long")
        dense = scratch.keep(listed.join(crowded, ["mask_", "key_"], "left_semi").select("mask_", "fp_"), "simhash-dense")
        listed = dense.join(F.broadcast(table), "mask_").select(F.col("finer_").alias("mask_"), F.col("fp_").bitwiseAND(F.col("finer_")).alias("key_"), "fp_")
        masks = sorted({x for some in finer.values() for x in some})


def _grouped(docs: DataFrame, id_col: str, text_col: str, words: int = 3, seed: int = 42, bits: int = 3, **options) -> DataFrame:
    """(id_, mark_, fp_, root_, component_id) for each row."""
    rows = scratch.keep(fingerprints(docs, id_col, text_col, words, seed), "simhash-rows", batch_rows=2000)
    distinct = scratch.keep(rows.groupBy("fp_").agg(F.min("id_").alias("least_")), "simhash-distinct")
    found = components(links(distinct.select("fp_"), bits, **options))
    rooted = distinct.join(found, distinct["fp_"] == found["node"], "left").select(
        "fp_", "least_", F.coalesce("root", "fp_").alias("root_")
    )
    rooted = scratch.keep(rooted, "simhash-rooted")
    heads = rooted.groupBy("root_").agg(F.min("least_").alias("component_id"))
    return rows.join(rooted.join(heads, "root_").select("fp_", "root_", "component_id"), "fp_")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id (smallest id reachable)."""
    return _grouped(docs, id_col, text_col, **options).select(
        F.col("id_").alias(id_col), F.lower(F.lpad(F.hex("fp_"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay: of each component one with the smallest id (null is the largest).

    Rows that repeat it stay only once; of several texts under that id one stays.
    """
    return keep_heads(docs, _grouped(docs, id_col, text_col, **options), id_col, text_col)


def _sketches(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id_, mark_, size_, the whole, keys_) for each row; size_ counts shingles, keys_ are the blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingles(t, words) for t in batch["text_"]]
            found = [sketch(x) for x in sets]
            wholes = np.array([w for w, _ in found], np.uint64).reshape(-1, len(_WHOLE)).view(np.int64)
            out = {"id_": batch["id_"], "mark_": batch["mark_"], "size_": np.array([len(x) for x in sets], np.int64)}
            yield pd.DataFrame(out | {w: wholes[:, i] for i, w in enumerate(_WHOLE)} | {"keys_": [k.view(np.int64) for _, k in found]})

    wholes = ", ".join(f"{w} long" for w in _WHOLE)
    found = _rows(docs, id_col, text_col).mapInPandas(released(run), f"id_ string, mark_ long, size_ long, {wholes}, keys_ array<long>")
    return found.withColumn("id_", F.col("id_").cast("long"))


def _close(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The ``pairs`` (u, v) whose sizes allow a similarity of ``least`` and whose wholes differ in few bits."""
    of = lambda name: texts.select(F.col("mark_").alias(name), F.struct("size_", *_WHOLE).alias(f"x{name}"))
    both = pairs.join(of("u"), "u").join(of("v"), "v")
    differ = sum((F.bit_count(F.col(f"xu.{w}").bitwiseXOR(F.col(f"xv.{w}"))) for w in _WHOLE), F.lit(0))
    sizes = F.least("xu.size_", "xv.size_") >= F.lit(least) * F.greatest("xu.size_", "xv.size_")
    most = F.when(F.least("xu.size_", "xv.size_") < _SMALL, _WHOLE_BITS[1]).otherwise(_WHOLE_BITS[0])
    return both.where(sizes & (differ <= most)).select("u", "v")


def _of_marks(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """One of the ``rows`` for each of the distinct ``marks`` (mark_) that has any, without a shuffle of all texts to find few.

    A bitmap of 2**``_SIEVE`` numbers at most is broadcast, whatever the size of the tables; of n marks
    about n / 2**24 of the other rows pass it and meet the join.  The join is an inner one, as
    the optimizer would put a semi join below the bitmap.
    """
    place = F.col("mark_").bitwiseAND((1 << _SIEVE) - 1)
    bit = f"shiftleft(1L, int(shiftrightunsigned(mark_, {_SIEVE}) & 63))"
    bitmap = marks.groupBy(place.alias("place_")).agg(F.bit_or(F.expr(bit)).alias("bits_"))
    found = rows.join(F.broadcast(bitmap), place == F.col("place_")).where(F.expr(f"bits_ & {bit} <> 0"))
    return found.drop("place_", "bits_").join(marks, "mark_").dropDuplicates(["mark_"])


def _alike(pairs: DataFrame, docs: DataFrame, text_col: str, words: int, least: float) -> DataFrame:
    """The ``pairs`` (u, v) of marks whose whole texts have a similarity of ``least`` or more."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[int, np.ndarray] = {}  # the same texts come again and again
        held = 0

        def of_text(node: int, text: str) -> np.ndarray:
            nonlocal held
            found = known.get(node)
            if found is None:
                found = shingles(text, words)
                if held + found.nbytes > _HELD:
                    known.clear()
                    held = 0
                held += found.nbytes
                known[node] = found
            return found

        for batch in batches:
            pairs = zip(batch["u"], batch["v"], batch["text_u"], batch["text_v"], strict=True)
            good = [similarity(of_text(u, a), of_text(v, b)) >= least for u, v, a, b in pairs]
            yield batch.loc[np.array(good, bool), ["u", "v"]]

    nodes = pairs.select(F.explode(F.array("u", "v")).alias("mark_")).distinct()
    texts = docs.select(mark(text_col).alias("mark_"), F.coalesce(F.col(text_col), F.lit("")).alias("text_"))
    texts = scratch.keep(_of_marks(texts, nodes), "similar-texts")
    of = lambda name: texts.select(F.col("mark_").alias(name), F.col("text_").alias(f"text_{name}"))
    both = pairs.join(of("v"), "v").join(of("u"), "u").select("u", "v", "text_u", "text_v")
    return scratch.keep(both.mapInPandas(released(run), "u long, v long"), "similar-edges", batch_rows=1000)


def _sets(docs: DataFrame, marks: DataFrame, text_col: str, words: int) -> DataFrame:
    """(mark_, set_): the shingles of the texts with these marks, as bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"mark_": batch["mark_"], "set_": [shingles(t, words).tobytes() for t in batch["text_"]]})

    texts = docs.select(mark(text_col).alias("mark_"), F.coalesce(F.col(text_col), F.lit("")).alias("text_"))
    wanted = _of_marks(texts, marks.select("mark_").distinct())
    return scratch.keep(wanted.mapInPandas(released(run), "mark_ long, set_ binary"), "similar-sets", batch_rows=2000)


def _crossing(members: DataFrame, least: float) -> DataFrame:
    """Edges that join the components of a tile (g_, p_, q_) as its links do: between parts p_ and q_, or within p_ = q_.

    Every pair of different components is compared exactly, a text with all others at once: its
    shingles are flagged among those of the tile, and the flags are summed by text.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            rest = batch if rest is None else pd.concat((rest, batch), ignore_index=True)
            names = rest[["g_", "p_", "q_"]].to_numpy()
            cuts = np.flatnonzero((names[1:] != names[:-1]).any(1)) + 1
            if len(cuts):
                yield edges_of(rest.iloc[: cuts[-1]], cuts[:-1])
                rest = rest.iloc[cuts[-1] :].reset_index(drop=True)
        if rest is not None:
            yield edges_of(rest, np.array([], np.int64))

    def edges_of(rows: pd.DataFrame, cuts: np.ndarray) -> pd.DataFrame:
        edges, ends = [], np.append(cuts, len(rows))
        for i, j in zip(np.concatenate(([0], cuts)), ends, strict=True):
            edges += joined(rows.iloc[i:j])
        return pd.DataFrame(edges, columns=["u", "v"], dtype="int64")

    def joined(tile: pd.DataFrame) -> list[tuple[int, int]]:
        node, side, roots = tile["mark_"].to_numpy(), tile["part_"].to_numpy(), np.unique(tile["root_"], return_inverse=True)[1]
        within, edges = tile["p_"].iloc[0] == tile["q_"].iloc[0], []
        largest = np.bincount(roots).argmax()
        todo = np.flatnonzero(roots != largest)  # of every pair of components one is not the largest
        if not len(todo):
            return edges
        sets = [np.frombuffer(x, "<u8") for x in tile["set_"]]
        sizes = np.array([len(x) for x in sets])
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        known, places = np.unique(np.concatenate(sets), return_inverse=True)
        flags = np.zeros(len(known), bool)
        for k in todo:
            mine = places[starts[k] : starts[k] + sizes[k]]
            flags[mine] = True
            both = np.add.reduceat(flags[places], starts, dtype=np.int64)
            flags[mine] = False
            links = (both >= least * (sizes + sizes[k] - both)) & (roots != roots[k])
            for other in np.flatnonzero(links if within else links & (side != side[k])):
                if roots[other] != roots[k]:
                    edges.append((int(node[k]), int(node[other])))
                    roots[roots == roots[other]] = roots[k]
        return edges

    rows = members.select("g_", "p_", "q_", "part_", "mark_", "root_", "set_")
    return rows.repartition("g_", "p_", "q_").sortWithinPartitions("g_", "p_", "q_").mapInPandas(released(run), "u long, v long")


def _tiles(members: DataFrame, crowd: int) -> DataFrame:
    """``members`` of crowded groups (of n_ texts and shingles_), dealt to parts; each pair of parts of a group is a tile."""
    parts = F.greatest(F.ceil(F.col("n_") / crowd), F.least(F.ceil(F.col("shingles_") / _LONG), F.col("n_"))).cast("int")
    dealt = members.withColumn("part_", F.pmod(F.xxhash64("mark_"), parts).cast("int"))
    tiled = dealt.withColumn("o_", F.explode(F.sequence(F.lit(0), parts - 1)))
    return tiled.withColumns({"p_": F.least("part_", "o_"), "q_": F.greatest("part_", "o_")})


def _similar(docs: DataFrame, id_col: str, text_col: str, words: int = 5, least: float = 0.8, crowd: int = 2048, levels: int = 3) -> DataFrame:
    """(id_, mark_, root_) for each row."""
    rows = scratch.keep(_sketches(docs, id_col, text_col, words), "similar-rows", batch_rows=2000)
    texts = scratch.keep(rows.drop("id_").dropDuplicates(["mark_"]), "similar-distinct")
    keys = texts.select("mark_", F.posexplode("keys_").alias("i_", "key_"))
    listed = keys.select(F.xxhash64("i_", "key_").alias("g_"), F.expr("shiftleft(1L, i_)").alias("used_"), "mark_")
    roots = texts.select(F.col("mark_").alias("mark_"), F.col("mark_").alias("root_"))
    edges = seen = None

    def linked(found: DataFrame, name: str) -> DataFrame:
        """Roots after the edges that were ``found`` are counted as well."""
        nonlocal edges
        found = scratch.keep(found, name, batch_rows=1000)
        if not found.limit(1).count():
            return roots
        edges = found if edges is None else edges.unionByName(found)
        every = texts.select("mark_").join(components(edges).withColumnRenamed("node", "mark_"), "mark_", "left")
        return scratch.keep(every.select("mark_", F.coalesce("root", "mark_").alias("root_")), "similar-roots")

    def stars(members: DataFrame) -> DataFrame:
        """Edges between the smallest of a block and the others that are like it."""
        nonlocal seen
        pairs = members.where("mark_ <> h_").select(F.col("h_").alias("u"), F.col("mark_").alias("v")).distinct()
        pairs = pairs if seen is None else pairs.join(seen, ["u", "v"], "left_anti")
        pairs = scratch.keep(_close(pairs, texts, least), "similar-pairs")
        seen = pairs if seen is None else seen.unionByName(pairs)
        return _alike(pairs, docs, text_col, words, least)

    first = listed.where(F.col("used_") < 1 << _FIRST)
    heads = first.groupBy("g_").agg(F.min("mark_").alias("h_"), F.max("mark_").alias("z_")).where("h_ <> z_").select("g_", "h_")
    roots = linked(stars(first.join(heads, "g_")), "similar-first")
    for level in range(levels):
        rooted = listed.join(roots.join(texts.select("mark_", "size_"), "mark_"), "mark_")
        counted = rooted.groupBy("g_").agg(
            F.count(F.lit(1)).alias("n_"), F.sum("size_").alias("shingles_"), F.min("mark_").alias("h_"), F.min("root_").alias("a_"), F.max("root_").alias("z_")
        )
        mixed = counted.where("a_ <> z_").select("g_", "n_", "shingles_", "h_")
        members = scratch.keep(rooted.join(mixed, "g_"), "similar-members")  # what shares a block and is not linked yet
        if not members.limit(1).count():
            break
        # Groups are small by the number of their texts and by their length.
        small = (F.col("n_") <= crowd) & ((F.col("shingles_") <= _LONG) | (F.col("n_") <= 2))
        few, many = members.where(small).withColumns({c: F.lit(0) for c in ("part_", "p_", "q_")}), members.where(~small)
        crowded, last = bool(many.limit(1).count()), level + 1 == levels
        wanted = members if crowded and last else few
        sets = _sets(docs, wanted, text_col, words)
        found = _crossing(few.join(sets, "mark_"), least)
        if crowded:
            found = found.unionByName(_crossing(_tiles(many, crowd).join(sets, "mark_"), least) if last else stars(many))
        roots = linked(found, "similar-found")
        if not crowded:
            break
        finer = many.select("g_", "used_", "mark_").join(keys, "mark_").where("used_ & shiftleft(1L, i_) = 0")
        listed = finer.select(F.xxhash64("g_", "i_", "key_").alias("g_"), F.expr("used_ | shiftleft(1L, i_)").alias("used_"), "mark_")
    return rows.select("id_", "mark_").join(roots, "mark_")


def keep_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay when texts link by ``words``-word shingles at a similarity of ``least`` or more.

    As in ``keep_one`` it is one of each component with the smallest id.
    """
    return keep_heads(docs, _similar(docs, id_col, text_col, **options), id_col, text_col)


def keep_heads(docs: DataFrame, grouped: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that stay, one for each root_ of ``grouped`` (id_, mark_, root_)."""
    names = docs.columns
    first = F.min(F.struct(F.col("id_").isNull().alias("n"), "id_", "mark_")).alias("f_")
    heads = grouped.groupBy("root_").agg(first)
    kept = scratch.keep(heads.select(F.col("f_.id_").alias("keep_id_"), F.col("f_.mark_").alias("keep_mark_")), "simhash-kept")
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row_"), F.col(id_col).cast("long").alias("row_id_"), mark(text_col).alias("row_mark_")
    )
    rows = packed.join(kept, F.col("row_id_").eqNullSafe(F.col("keep_id_")) & (F.col("row_mark_") == F.col("keep_mark_")), "left_semi")
    if rows.select("row_id_").count() > kept.count():  # rows that are repeated
        rows = rows.dropDuplicates(["row_id_", "row_mark_"])
    return rows.select("row_.*")
