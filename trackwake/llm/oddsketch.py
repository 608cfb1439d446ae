"""MinHash near-duplicates, with odd sketches to verify banded candidates.

Each text is its set of word shingles. MinHash samples of the set are joined to
bands, and sets that share a band are candidates. All samples of a set are also
folded into an odd sketch: every sample flips one bit of a bitmap. Two sketches
differ, after XOR, in a number of bits that tells how many samples differ; near
the top this estimates similarity far more sharply than a band does, so few pairs
are left to be confirmed on their full sets.

Only connections matter, so links are found in two rounds, the second of which
leaves out what the first connects: one partner of every set, then the other
candidates of small bands and, for bands that many sets share, blocks against
blocks inside a task that hands on no more links than it has members.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType

from trackwake.llm.common import checkpointed
from trackwake.llm.components import components

SIMILARITY = 80  # percent
SHINGLE = 5
#: A pair of just the similarity shares no band with probability (1 - 0.8^5)^40, 1e-7.
BANDS = 40
ROWS = 5
SAMPLES = BANDS * ROWS
SKETCH_BITS = 512
#: Of pairs of just the similarity, one in ten million has sketches further apart.
SAFETY = 5.2
#: Bands shared by more sets are worked out in blocks, not as pairs.
PAIR_LIMIT = 32
#: Characters of text in a block.
BLOCK_CHARS = 8 << 20
#: Keys with more rows than this, or than a thousandth of all, are dealt to several tasks.
SPLIT_ROWS = 100_000
MOST_SPLIT = 1000

_U64 = np.uint64
_DRAW = np.random.default_rng(20_11)
_FACTORS = _DRAW.integers(0, 1 << 63, SAMPLES, dtype=np.uint64) * _U64(2) + _U64(1)
_SHIFTS = _DRAW.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)
_NUMBER = np.arange(1, SAMPLES + 1, dtype=np.uint64) * _U64(0x9E3779B97F4A7C15)


def sketch_limit(similarity: int = SIMILARITY) -> int:
    """The number of differing sketch bits that a pair of this similarity stays within.

    Of k samples Binomial(k, 1 - s) differ; each flips one bit in either sketch. The
    mean and variance of the bits that remain odd follow from the balls in n bins.
    """
    n, k, other = SKETCH_BITS, SAMPLES, 1 - similarity / 100
    balls = 2 * k * other
    mean = n / 2 * (1 - (1 - 2 / n) ** balls)
    full = balls / n
    parity = n / 4 * (1 - exp(-4 * full) - 4 * full * exp(-4 * full))
    slope = 2 * exp(-2 * full)
    spread = sqrt(parity + slope**2 * k * other * (1 - other))
    return int(mean + SAFETY * spread)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U64(32))) * _U64(0xD6E8FEB86659FD93)
    return x ^ (x >> _U64(32))


class _WordHashes(dict):
    """Hashes of words met lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 18:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


_WORDS = _WordHashes()


def shingle_set(text: str | bytes | None, width: int) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes.

    A-Z count as a-z. A text of fewer words than a shingle has is one shingle; a
    text without a word has none.
    """
    plain = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    words = plain.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    codes = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    width = min(width, len(words))
    hashes = np.full(len(codes) - width + 1, width, np.uint64)
    for k in range(width):
        hashes = _mixed(hashes * _U64(0x9E3779B97F4A7C15) + codes[k : k + len(hashes)])
    return np.unique(hashes)


def min_samples(shingles: np.ndarray) -> np.ndarray:
    """The MinHash samples of a set that is not empty."""
    least = np.full(SAMPLES, ~_U64(0))
    for at in range(0, len(shingles), 512):
        part = _FACTORS[:, None] * shingles[None, at : at + 512]
        part += _SHIFTS[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    return least


def band_keys(samples: np.ndarray) -> np.ndarray:
    """One key a band; keys of different bands differ."""
    rows = samples.reshape(BANDS, ROWS)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        keys = _mixed(keys * _U64(0x9E3779B97F4A7C15) + rows[:, k])
    return keys.view(np.int64)


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """The samples folded into a bitmap by parity, as 64-bit words."""
    places = (_mixed(samples + _NUMBER) % _U64(SKETCH_BITS)).astype(np.int64)
    odd = (np.bincount(places, minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.uint64)


def linked(a: np.ndarray, b: np.ndarray, similarity: int = SIMILARITY) -> bool:
    """Whether two full sets are as similar as asked for."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < similarity * len(b):
        return False
    place = np.searchsorted(b, a)
    place[place == len(b)] = 0
    both = int((b[place] == a).sum())
    return 100 * both >= similarity * (len(a) + len(b) - both)


# -- what a text is reduced to ---------------------------------------------------


def _printer(width: int, id_type: str):
    def print_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sizes, nodes, bands, sketches = [], [], [], []
                for text in part.column(2).to_pylist():
                    shingles = shingle_set(text, width)
                    sizes.append(len(shingles))
                    if not len(shingles):
                        nodes.append(None), bands.append(None), sketches.append(None)
                        continue
                    samples = min_samples(shingles)
                    node = xxhash.xxh64_intdigest(shingles.tobytes())
                    nodes.append(node - (1 << 64) if node >> 63 else node)
                    bands.append(band_keys(samples))
                    sketches.append(odd_sketch(samples).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array(sizes, pa.int64()),
                        pa.array(nodes, pa.int64()),
                        pa.array(bands, pa.list_(pa.int64())),
                        pa.array(sketches, pa.binary()),
                    ],
                    ["doc_id", "row", "n_shingles", "node", "bands", "sketch"],
                )

    schema = f"doc_id {id_type}, row long, n_shingles long, node long, bands array<long>, sketch binary"
    return print_texts, schema


# -- candidates -------------------------------------------------------------------


def measured_join(rows: DataFrame, lookup: DataFrame, key: str, deal: Column, n: str, total: int) -> DataFrame:
    """Inner join of `rows` with a lookup that knows how many rows, `n`, a key has.

    Keys with more than their share are met in as many places as their count asks
    for; `deal` says in which. At most MOST_SPLIT keys are told to all tasks.
    """
    share = max(SPLIT_ROWS, total // MOST_SPLIT)
    places = F.ceil(F.col(n) / share).cast("int")
    hot = lookup.where(F.col(n) > share).select(key, places.alias("_places"))
    told = rows.join(F.broadcast(hot), key, "left")
    dealt = told.withColumn(
        "_place", F.pmod(F.xxhash64(deal), F.coalesce("_places", F.lit(1))).cast("int")
    ).drop("_places")
    copies = lookup.withColumn("_place", F.explode(F.sequence(F.lit(0), F.greatest(places, F.lit(1)) - 1)))
    return dealt.join(copies, [key, "_place"]).drop("_place")


def _close_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs within a band's members whose sketches are close; rows hold one band each."""
    limit = sketch_limit()
    for batch in batches:
        members = batch.column(0)
        sizes = np.diff(members.offsets.to_numpy())
        flat = members.flatten()
        nodes = flat.field("node").to_numpy()
        packed = b"".join(flat.field("sketch").to_pylist())
        sketches = np.frombuffer(packed, np.uint64).reshape(len(nodes), -1)
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
        for size in np.unique(sizes[sizes > 1]):
            at = starts[sizes == size]
            x, y = np.triu_indices(int(size), 1)
            step = max(1, 100_000 // len(x))
            for first in range(0, len(at), step):
                group = at[first : first + step, None]
                a, b = (group + x).ravel(), (group + y).ravel()
                apart = np.bitwise_count(sketches[a] ^ sketches[b]).sum(axis=1)
                a, b = nodes[a[apart <= limit]], nodes[b[apart <= limit]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"]
                )


@F.pandas_udf(BooleanType())
def _close(a: pd.Series, b: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype=bool)
    x, y = (np.frombuffer(b"".join(s), np.uint64).reshape(len(s), -1) for s in (a, b))
    return pd.Series(np.bitwise_count(x ^ y).sum(axis=1) <= sketch_limit())


def _confirmer(width: int, similarity: int):
    @F.pandas_udf(BooleanType())
    def confirmed(a: pd.Series, b: pd.Series, text_a: pd.Series, text_b: pd.Series) -> pd.Series:
        # Rows that follow each other share a side, so a few sets are kept.
        held: dict[int, np.ndarray] = {}

        def of(node: int, text) -> np.ndarray:
            if node not in held:
                if len(held) >= 32:
                    held.clear()
                held[node] = shingle_set(text, width)
            return held[node]

        rows = zip(a, b, text_a, text_b)
        return pd.Series([linked(of(i, s), of(j, t), similarity) for i, j, s, t in rows], dtype=bool)

    return confirmed


def _confirm(pairs: DataFrame, texts: DataFrame, width: int, similarity: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar."""
    first = texts.select(F.col("node").alias("a"), F.col("text").alias("_text_a"))
    second = texts.select(F.col("node").alias("b"), F.col("text").alias("_text_b"))
    met = pairs.select("a", "b").join(first, "a").join(second, "b")
    confirmed = _confirmer(width, similarity)
    return met.where(confirmed("a", "b", "_text_a", "_text_b")).select("a", "b")


# -- bands that many sets share -------------------------------------------------------


def _block_linker(width: int, similarity: int):
    """Links between two blocks of a band's members, or inside one block.

    A pair is looked at only under the first band that it shares, and only while
    nothing connects it yet, so there are fewer links than members.
    """
    limit = sketch_limit(similarity)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def link(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        band, low, high = (k.as_py() for k in key)
        nodes = table.column("node").to_numpy()
        blocks = table.column("block").to_numpy()
        sketches = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(len(nodes), -1)
        keys = np.array(table.column("bands").to_pylist(), np.int64)
        where = int(np.flatnonzero(keys[0] == band)[0])
        texts = table.column("text")
        group = np.unique(table.column("root").to_numpy(), return_inverse=True)[1]
        sets: dict[int, np.ndarray] = {}

        def of(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = shingle_set(texts[i].as_py(), width)
            return sets[i]

        found = []
        for i in range(len(nodes) - 1):
            rest = slice(i + 1, None)
            near = (group[rest] != group[i]) & ((low == high) | (blocks[rest] != blocks[i]))
            near = np.flatnonzero(near) + i + 1
            near = near[np.bitwise_count(sketches[near] ^ sketches[i]).sum(axis=1) <= limit]
            near = near[(keys[near] == keys[i]).argmax(axis=1) == where]
            for j in near.tolist():
                if group[i] != group[j] and linked(of(i), of(j), similarity):
                    found.append({"a": int(nodes[i]), "b": int(nodes[j])})
                    group[group == group[j]] = group[i]
        return pa.Table.from_pylist(found, schema)

    return link


def _crowd_links(crowd: DataFrame, nodes: DataFrame, texts: DataFrame, roots: DataFrame, width: int, similarity: int) -> DataFrame:
    """Links in large bands between sets that are not connected yet."""
    named = roots.withColumnRenamed("node", "_node")
    rooted = crowd.join(named, F.col("node") == F.col("_node"), "left").select(
        "key", "node", F.coalesce("root", "node").alias("root")
    )
    split = (
        rooted.groupBy("key")
        .agg(F.min("root").alias("_low"), F.max("root").alias("_high"))
        .where("_low != _high")
        .select("key")
    )
    members = (
        rooted.join(split, "key")
        .join(texts, "node")
        .join(nodes.select("node", "bands", "sketch"), "node")
    )
    chars = (
        rooted.join(split, "key")
        .join(texts.select("node", F.length("text").alias("_chars")), "node")
        .groupBy("key")
        .agg(F.sum("_chars").alias("_chars"))
        .select("key", F.ceil(F.col("_chars") / BLOCK_CHARS).cast("int").alias("_blocks"))
    )
    dealt = members.join(chars, "key").withColumn(
        "block", F.pmod(F.xxhash64("node"), F.greatest("_blocks", F.lit(1))).cast("int")
    )
    other = F.explode(F.sequence(F.lit(0), F.greatest("_blocks", F.lit(1)) - 1))
    paired = dealt.withColumn("_other", other).select(
        "key",
        F.least("block", "_other").alias("low"),
        F.greatest("block", "_other").alias("high"),
        "node", "root", "bands", "sketch", "text", "block",
    )
    return paired.groupBy("key", "low", "high").applyInArrow(
        _block_linker(width, similarity), "a long, b long"
    )


# -- the operator ---------------------------------------------------------------------


def _forest_roots(parents: DataFrame) -> DataFrame:
    """(node, root) of every child in (a, b), where a child b has one smaller parent a.

    Every round lets each node point to where its parent points, so a chain of n
    links takes log n rounds, each written to the checkpoint folder.
    """
    reached = parents.select(F.col("b").alias("node"), F.col("a").alias("root"))
    while True:
        onward = reached.select(F.col("node").alias("root"), F.col("root").alias("_next"))
        moved = checkpointed(
            reached.join(onward, "root", "left").select(
                "node", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")
            )
        )
        reached = moved.select("node", "root")
        if moved.where("_moved").isEmpty():
            return reached


def _links(docs: DataFrame, nodes: DataFrame, total: int, text: str, id: str, width: int, similarity: int) -> tuple[DataFrame, DataFrame]:
    """(node, root) that nearest partners lead to, and links that connect the rest."""
    members = nodes.select("node", F.explode("bands").alias("key"))
    shared = (
        members.groupBy("key")
        .agg(F.count("*").alias("n"), F.min("node").alias("hub"), F.max("node").alias("end"))
        .where("n > 1")
    )
    met = checkpointed(measured_join(members, shared, "key", F.col("node"), "n", total * BANDS))
    sketches = nodes.select("node", "sketch")
    few = (
        met.where(F.col("n") <= PAIR_LIMIT)
        .select("key", "node")
        .join(sketches, "node")
        .groupBy("key")
        .agg(F.collect_list(F.struct("node", "sketch")).alias("members"))
    )
    pairs = few.select("members").mapInArrow(_close_pairs, "a long, b long").distinct()
    crowd = met.where(F.col("n") > PAIR_LIMIT)
    hubs = (
        crowd.select("node", F.explode(F.array("hub", "end")).alias("_hub"))
        .where("node != _hub")
        .select(F.least("node", "_hub").alias("a"), F.greatest("node", "_hub").alias("b"))
        .distinct()
    )
    close = (
        hubs.join(sketches.select(F.col("node").alias("a"), F.col("sketch").alias("_x")), "a")
        .join(sketches.select(F.col("node").alias("b"), F.col("sketch").alias("_y")), "b")
        .where(_close("_x", "_y"))
        .select("a", "b")
    )
    candidates = checkpointed(pairs.union(close).distinct())
    wanted = (
        candidates.select(F.explode(F.array("a", "b")).alias("node"))
        .union(crowd.select("node"))
        .distinct()
    )
    # One row stands for all that have its set.
    standing = nodes.select("node", "row").join(wanted, "node")
    texts = checkpointed(
        docs.select(F.xxhash64(id, text).alias("row"), F.col(text).alias("text"))
        .join(standing, "row")
        .groupBy("node")
        .agg(F.first("text").alias("text"))
    )
    nearest = candidates.groupBy("b").agg(F.min("a").alias("a"))
    roots = _forest_roots(checkpointed(_confirm(nearest, texts, width, similarity)))
    apart = _by_root(candidates.join(nearest, ["a", "b"], "left_anti"), roots).where("_a != _b")
    more = _confirm(apart, texts, width, similarity)
    crowded = _crowd_links(crowd.select("key", "node"), nodes, texts, roots, width, similarity)
    return roots, more.union(crowded)


def _by_root(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs (a, b) with the roots of both, in `_a` and `_b`."""
    for side in ("a", "b"):
        named = roots.select(F.col("node").alias(side), F.col("root").alias(f"_{side}"))
        pairs = pairs.join(named, side, "left").withColumn(f"_{side}", F.coalesce(f"_{side}", side))
    return pairs


def near_duplicates(
    docs: DataFrame,
    *,
    id: str = "doc_id",
    text: str = "text",
    width: int = SHINGLE,
    similarity: int = SIMILARITY,
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of `docs`.

    Sets of word shingles with a Jaccard similarity of `similarity` percent or more
    are linked; `component_id` is the smallest doc_id reachable, null where no
    reachable row has an id. `kept` is true where that is the row's own id (or both
    are null). Texts of fewer words than a shingle are one shingle; null, empty
    and wordless texts have the empty set, link with nothing and keep their own
    id. Equal sets are one node, so copies and repeated rows form no pairs. Texts of
    any length are taken whole; other columns do not matter.

    Confirmation compares full sets by 64-bit hashes. What can be missed is a pair
    that shares none of the bands (1e-7 at the similarity, far less above it) or whose
    sketches are unusually far apart (1e-7), and is linked by no other way either.
    """
    if similarity < SIMILARITY:
        raise ValueError(f"bands and sketches are made for {SIMILARITY} percent or more")
    read = docs.select(F.col(id).alias("doc_id"), F.xxhash64(id, text).alias("row"), F.col(text).alias("text"))
    printer, schema = _printer(width, read.schema["doc_id"].dataType.simpleString())
    printed = checkpointed(read.mapInArrow(printer, schema))
    nodes = checkpointed(
        printed.where("node IS NOT NULL")
        .groupBy("node")
        .agg(
            F.count("*").alias("copies"),
            F.min("doc_id").alias("least"),
            F.min("row").alias("row"),
            F.first("bands").alias("bands"),
            F.first("sketch").alias("sketch"),
        )
    )
    total = nodes.count()
    roots, rest = _links(docs, nodes, total, text, id, width, similarity)
    over = components(_by_root(rest, roots).select(F.col("_a").alias("a"), F.col("_b").alias("b")))
    first = roots.select(F.col("node").alias("_node"), F.col("root").alias("_first"))
    last = over.select(F.col("node").alias("_first"), F.col("root").alias("_last"))
    rooted = (
        nodes.select("node", "copies", "least")
        .join(first, F.col("node") == F.col("_node"), "left")
        .withColumn("_first", F.coalesce("_first", "node"))
        .join(last, "_first", "left")
        .select("node", "copies", "least", F.coalesce("_last", "_first").alias("root"))
    )
    groups = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("_sets"))
    by_node = measured_join(
        rooted.select("node", "copies", "root"), groups, "root", F.col("node"), "_sets", total
    ).select("node", "copies", "component_id")
    rows = printed.select("doc_id", "n_shingles", "node")
    in_groups = measured_join(
        rows.where("node IS NOT NULL"), by_node, "node", F.col("doc_id"), "copies", printed.count()
    ).select("doc_id", "n_shingles", "component_id")
    alone = rows.where("node IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return in_groups.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
