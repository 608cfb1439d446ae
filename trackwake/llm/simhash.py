"""SimHash near-duplicates, with pigeonring pruning of candidate pairs.

A fingerprint is a ring of three segments. Two fingerprints within two bits
have a place on the ring from where every chain of consecutive segments keeps
to its share of the two bits: none in the first segment, at most one in the
first two, at most two in all. A pair must meet in such a chain of two segments,
by an equi-join, before its bits are counted in full.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import LongType

from trackwake.llm.common import checkpointed, spread_join
from trackwake.llm.components import components

BITS = 64
MAX_DIFFERENCES = 2
SHINGLE = 3
HASH_SEED = 42
#: Chains with more rows are linked through their common neighbours instead.
PAIR_LIMIT = 128
BORDERS = (0, 22, 43, 64)
PLACES = len(BORDERS) - 1


def text_fingerprint(text: str | None) -> int:
    """The fingerprint of one text as a signed 64-bit number; 0 without a word."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    if len(found) < SHINGLE:
        shingles = [b" ".join(found)]
    else:
        shingles = map(b" ".join, zip(*(found[k:] for k in range(SHINGLE))))
    hashes = np.fromiter(
        (xxhash.xxh64_intdigest(s, HASH_SEED) for s in shingles), np.uint64
    )
    bits = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096].astype(">u8").view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    packed = np.packbits(2 * bits > len(hashes)).view(">u8")[0]
    return int(np.uint64(packed).astype(np.int64))


@F.pandas_udf(LongType())
def fingerprint(texts: pd.Series) -> pd.Series:
    return texts.map(text_fingerprint).astype("int64")


def _segment(print_: Column, k: int) -> Column:
    low = BORDERS[k]
    width = BORDERS[k + 1] - low
    return F.shiftrightunsigned(print_, low).bitwiseAND(F.lit((1 << width) - 1))


def _chains_at(k: int) -> Column:
    """The chains that begin at segment k, as an array of (key, probe)."""
    after = (k + 1) % PLACES
    second = _segment(F.col("print"), after)
    first = F.shiftleft(_segment(F.col("print"), k), 24)
    key = first.bitwiseOR(F.lit(k << 48).cast("long")).bitwiseOR(second)
    width = BORDERS[after + 1] - BORDERS[after]
    bits = F.array(*(F.lit(1 << j).cast("long") for j in range(width)))
    lacking = F.filter(bits, lambda bit: second.bitwiseAND(bit) == 0)
    probes = F.transform(
        lacking,
        lambda bit: F.struct(key.bitwiseOR(bit).alias("key"), F.lit(1).alias("probe")),
    )
    own = F.array(F.struct(key.alias("key"), F.lit(0).alias("probe")))
    return F.concat(own, probes)


def _chains(prints: DataFrame) -> DataFrame:
    """(key, probe, print): the chains in which a fingerprint may meet another.

    A key is the place on the ring, the first segment and the second. A probe
    has one bit of the second segment set that the fingerprint lacks, so that two
    fingerprints one bit apart meet once.
    """
    chains = F.concat(*(_chains_at(k) for k in range(PLACES)))
    return prints.select("print", F.inline(chains)).select("key", "probe", "print")


def _differences(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def print_links(prints: DataFrame) -> DataFrame:
    """Links (a, b) that connect what is within two bits, from distinct `print`s.

    Chains of up to PAIR_LIMIT rows give their pairs. Fingerprints that meet in
    larger ones are joined with all at one bit's distance: two of them are within
    two bits exactly if they share such a neighbour, and each is then linked to the
    smallest that shares it. So no group is ever spelled out in pairs, and every
    link is found on one way or the other.
    """
    chains = _chains(prints)
    sizes = chains.groupBy("key").agg(
        F.count("*").alias("n"), F.sum(1 - F.col("probe")).alias("own")
    ).where("n > 1 and own > 0")
    met = spread_join(chains, sizes, "key", F.col("print"))
    few = (
        met.where(F.col("n") <= PAIR_LIMIT)
        .groupBy("key")
        .agg(F.collect_list(F.struct("probe", "print")).alias("_members"))
    )
    pairs = few.select(F.explode("_members").alias("x"), "_members").where("x.probe = 0")
    own = F.col("x.print")
    close = F.filter(
        "_members",
        lambda y: (_differences(y["print"], own) <= MAX_DIFFERENCES)
        & ((y["probe"] == 1) | (y["print"] < own)),
    )
    pairs = pairs.select(
        own.alias("a"), F.explode(F.transform(close, lambda y: y["print"])).alias("b")
    )
    crowd = met.where(F.col("n") > PAIR_LIMIT).select("print").distinct()
    flips = F.array(F.lit(0).cast("long"), *(
        F.lit((1 << j) - (1 << 64 if j == 63 else 0)).cast("long") for j in range(BITS)
    ))
    near = crowd.select("print", F.explode(flips).alias("_flip")).select(
        F.col("print").bitwiseXOR(F.col("_flip")).alias("key"), "print"
    )
    shared = (
        near.groupBy("key")
        .agg(F.min("print").alias("b"), F.count("*").alias("n"))
        .where("n > 1")
        .drop("n")
    )
    stars = spread_join(near, shared, "key", F.col("print")).select(
        F.col("print").alias("a"), "b"
    )
    return pairs.union(stars).where("a != b").distinct()


def _grouped(docs: DataFrame, id: str, text: str) -> DataFrame:
    """doc_id, print, root, component_id and a digest of the text for every row.

    `root` names the component by its smallest fingerprint, also where doc_ids
    are null or repeated.
    """
    printed = checkpointed(
        docs.select(
            F.col(id).alias("doc_id"),
            fingerprint(F.col(text)).alias("print"),
            F.xxhash64(text).alias("digest"),
        )
    )
    nodes = printed.groupBy("print").agg(F.min("doc_id").alias("_least"))
    roots = components(print_links(nodes.select("print")))
    rooted = nodes.join(roots, nodes["print"] == roots["node"], "left").select(
        "print", "_least", F.coalesce("root", "print").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("_least").alias("component_id"))
    named = spread_join(rooted, least, "root", F.col("print")).select("print", "root", "component_id")
    return spread_join(printed, named, "print", F.col("doc_id"))


def simhash_groups(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (long) and component_id for every row of `docs`.

    `component_id` is the smallest doc_id reachable over links between
    fingerprints within two bits, null where all of them are null. Equal
    fingerprints are one node, so copies form no pairs. Texts without a word
    share fingerprint zero. Repeated rows give as many results.
    """
    return _grouped(docs, id, text).select(
        "doc_id", F.col("print").alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """Of each group of near duplicates in `docs` the row with the smallest doc_id.

    All columns stay as they are. A group whose doc_ids are all null keeps a row
    without one. Of a group's rows that share the smallest doc_id, the one with
    the smallest digest of its text stays; rows alike in both are one. Groups
    that share a doc_id keep a row each.
    """
    groups = _grouped(docs, "doc_id", "text")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest"))
    kept = (
        groups.groupBy("root")
        .agg(first.alias("_first"))
        .select(F.col("_first.doc_id").alias("_kept"), F.col("_first.digest").alias("_digest"))
    )
    nested = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_doc"))
    own = nested.withColumn("_own", F.xxhash64("_doc.text"))
    chosen = own.join(
        kept, F.col("_doc.doc_id").eqNullSafe(F.col("_kept")) & (F.col("_own") == F.col("_digest"))
    )
    turn = F.row_number().over(Window.partitionBy("_kept", "_digest").orderBy("_own"))
    one = chosen.withColumn("_turn", turn).where("_turn = 1")
    return one.select(*(F.col("_doc")[c].alias(c) for c in docs.columns))
