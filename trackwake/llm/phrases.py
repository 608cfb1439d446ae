"""Phrase collocations, counted in quotient filters that are merged across shards.

Texts are gathered to shards. A shard knows every position's word as a number, and
a phrase as the pair of the two phrases, one word shorter, that it consists of:
a packed pair of 32-bit numbers. An invertible permutation spreads these pairs evenly,
so the upper bits of one, the quotient, serve as its slot in a table, and the rest,
the full remainder, is stored: nothing is lost, and counters take a byte each.

Shards count phrases of one length, their filters are cut by ranges of quotients,
and each range is merged over all shards by sorted order. Phrases that are frequent
enough are numbered, and every shard learns the numbers of its own. Longer phrases
are counted only where both parts are frequent, since no phrase is more frequent than
its parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from trackwake.llm.common import checkpointed

MIN_COUNT = 30
LONGEST = 4
TOP = 2000
#: A phrase goes where a longer one has this share, in percent, of its occurrences.
COVERED = 80
SCALE = 2_000_000
#: Words a shard gathers of one language, and words' worth of phrases a merge takes.
SHARD_WORDS = 1 << 20
RANGE_WORDS = 1 << 19
#: A language's phrases are ranked in so many parts first.
PARTS = 32
#: Word numbers are dealt in so many hashed rows.
DEALS = 1024

# What parts pieces, all of it one byte in UTF-8.
_PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
_PLAIN = bytes.maketrans(_PIECE_ENDS + b"\t", b"\n" * len(_PIECE_ENDS) + b" ")

_U64 = np.uint64
# The steps of a 64-bit finalizer, each of which can be undone.
_ODD = (_U64(0xBF58476D1CE4E5B9), _U64(0x94D049BB133111EB))
_BACK = tuple(_U64(pow(int(m), -1, 1 << 64)) for m in _ODD)


def permuted(keys: np.ndarray) -> np.ndarray:
    """Each 64-bit number as another one, one to one."""
    mixed = keys ^ (keys >> _U64(30))
    mixed = mixed * _ODD[0]
    mixed ^= mixed >> _U64(27)
    mixed = mixed * _ODD[1]
    return mixed ^ (mixed >> _U64(31))


def restored(mixed: np.ndarray) -> np.ndarray:
    """The inverse of `permuted`."""

    def unshift(x: np.ndarray, by: int) -> np.ndarray:
        out = x
        for _ in range(64 // by):
            out = x ^ (out >> _U64(by))
        return out

    keys = unshift(mixed, 31) * _BACK[1]
    keys = unshift(keys, 27) * _BACK[0]
    return unshift(keys, 30)


def pack_filter(keys: np.ndarray, counts: np.ndarray, shared_bits: int) -> bytes:
    """A counting quotient filter of distinct, sorted, permuted keys.

    The first `shared_bits` are alike in all keys and left out. As many of the
    next ones are the quotient as leave a remainder of whole bytes and about one
    key a slot; slots hold their number of keys, in a byte if that does. Counters
    of 255 and more follow in full.
    """
    bits = 64 - shared_bits
    width = max(1, -(-(bits - max(0, len(keys).bit_length() - 1)) // 8))
    slots_bits = max(0, bits - 8 * width)
    body = keys << _U64(shared_bits) if shared_bits else keys
    slots = (body >> _U64(64 - slots_bits)).astype(np.int64) if slots_bits else np.zeros(len(keys), np.int64)
    filled = np.bincount(slots, minlength=1 << slots_bits)
    remainder = (keys & _U64((1 << (8 * width)) - 1)) if width < 8 else keys
    slot_bytes = 1 if filled.max() < 256 else 4
    head = np.array([len(keys), shared_bits, slots_bits, slot_bytes], np.uint32).tobytes()
    top = (keys[0] >> _U64(bits)) if shared_bits else _U64(0)
    parts = remainder.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return b"".join(
        (
            head,
            np.array([top], np.uint64).tobytes(),
            filled.astype(f"<u{slot_bytes}").tobytes(),
            np.ascontiguousarray(parts).tobytes(),
            np.minimum(counts, 255).astype(np.uint8).tobytes(),
            counts[counts >= 255].astype("<u8").tobytes(),
        )
    )


def unpack_filter(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and counts of a filter."""
    n, shared_bits, slots_bits, slot_bytes = (int(x) for x in np.frombuffer(packed, np.uint32, 4))
    top = np.frombuffer(packed, np.uint64, 1, 16)[0]
    at = 24
    bits = 64 - shared_bits
    width = min(8, -(-(bits - slots_bits) // 8))
    filled = np.frombuffer(packed, f"<u{slot_bytes}", 1 << slots_bits, at)
    at += filled.nbytes
    parts = np.zeros((n, 8), np.uint8)
    parts[:, :width] = np.frombuffer(packed, np.uint8, n * width, at).reshape(n, width)
    at += n * width
    keys = parts.view("<u8").reshape(n).astype(np.uint64)
    if slots_bits:
        slots = np.repeat(np.arange(len(filled), dtype=np.uint64), filled)
        keys |= slots << _U64(8 * width)
    if shared_bits:
        keys |= top << _U64(bits)
    counts = np.frombuffer(packed, np.uint8, n, at).astype(np.int64)
    at += n
    large = counts == 255
    counts[large] = np.frombuffer(packed, "<u8", int(large.sum()), at).astype(np.int64)
    return keys, counts


def merge_filters(filters: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of all filters with their counts summed."""
    opened = [unpack_filter(f) for f in filters]
    keys = np.concatenate([k for k, _ in opened])
    counts = np.concatenate([c for _, c in opened])
    order = np.argsort(keys, kind="stable")  # a merge of sorted stretches
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


def _squeezed(values: np.ndarray) -> bytes:
    plain = values.astype("<u4").tobytes()
    return len(plain).to_bytes(8, "little") + pa.compress(plain, "zstd", asbytes=True)


def _unsqueezed(packed: bytes) -> np.ndarray:
    size = int.from_bytes(packed[:8], "little")
    return np.frombuffer(pa.decompress(packed[8:], size, "zstd", asbytes=True), "<u4")


class _Numbers(dict):
    """Words numbered in the order they come; 0 is a break."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class _Gathering:
    """Texts of one language on their way to a shard."""

    def __init__(self) -> None:
        self.numbers = _Numbers({b"\n": 0})
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, text: bytes) -> None:
        plain = text.lower().translate(_PLAIN).replace(b"\n", b" \n ")
        found = list(map(self.numbers.__getitem__, filter(None, plain.split(b" "))))
        if found:
            found.append(0)
            self.parts.append(np.array(found, np.uint32))
            self.size += len(found)

    def row(self, shard: int, lang: str) -> dict:
        codes = np.concatenate(self.parts)
        return {
            "shard": shard,
            "lang": lang,
            "words": list(self.numbers)[1:],
            "counts": np.bincount(codes, minlength=len(self.numbers))[1:],
            "codes": _squeezed(codes),
        }


_SHARD = pa.schema(
    [
        ("shard", pa.int64()),
        ("lang", pa.string()),
        ("words", pa.list_(pa.binary())),
        ("counts", pa.list_(pa.int64())),
        ("codes", pa.binary()),
    ]
)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shard = TaskContext.get().partitionId() << 32
    open_: dict[str, _Gathering] = {}

    def closed(lang: str) -> pa.RecordBatch:
        nonlocal shard
        shard += 1
        row = open_.pop(lang).row(shard, lang)
        return pa.RecordBatch.from_pylist([row], _SHARD)

    for batch in batches:
        langs = batch.column(0).to_pylist()
        for at, lang in enumerate(langs):
            text = batch.column(1)[at].as_py()
            if text:
                gathering = open_.setdefault(lang, _Gathering())
                gathering.add(text)
                if gathering.size >= SHARD_WORDS:
                    yield closed(lang)
    for lang in list(open_):
        if open_[lang].parts:
            yield closed(lang)


def _shards(docs: DataFrame, lang: str, text: str) -> DataFrame:
    read = docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"),
        F.col(text).cast("binary").alias("text"),
    )
    schema = "shard long, lang string, words array<binary>, counts array<long>, codes binary"
    return checkpointed(read.mapInArrow(_gathered, schema))


def _numbered_words(words: DataFrame, min_count: int) -> DataFrame:
    """(lang, word, a, id): frequent words with a number of their own per language."""
    frequent = (
        words.groupBy("lang", "word").agg(F.sum("n").alias("a")).where(F.col("a") >= min_count)
    )
    deal = F.pmod(F.xxhash64("lang", "word"), F.lit(DEALS))
    turn = F.row_number().over(Window.partitionBy("_deal").orderBy("lang", "word"))
    dealt = frequent.withColumn("_deal", deal)
    return checkpointed(dealt.select("lang", "word", "a", (turn * DEALS + F.col("_deal")).alias("id")))


def _recoded_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Codes of a shard's own words to numbers of the corpus; rare words become breaks."""
    for batch in batches:
        for row in batch.to_pylist():
            codes = _unsqueezed(row["codes"])
            numbers = np.zeros(int(codes.max()) + 1, np.uint32)
            for pair in row["known"]:
                numbers[pair["place"] + 1] = _small(pair["id"])
            yield _state(row["shard"], row["lang"], numbers[codes])


def _small(number: int) -> int:
    if number >> 32:
        raise ValueError("more than 2^32 frequent phrases of one length")
    return number


def _state(shard: int, lang: str, codes: np.ndarray) -> pa.RecordBatch:
    row = {"shard": shard, "lang": lang, "codes": _squeezed(codes)}
    return pa.RecordBatch.from_pylist([row], pa.schema([_SHARD.field(n) for n in row]))


_STATE = "shard long, lang string, codes binary"


def _pairs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where phrases one longer begin, and their permuted pairs."""
    places = np.flatnonzero((codes[:-1] != 0) & (codes[1:] != 0))
    keys = codes[places].astype(np.uint64) << _U64(32) | codes[places + 1].astype(np.uint64)
    return places, permuted(keys)


def _filters_of(range_bits: int):
    """From the state of shards to their filters, one a range of quotients."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, counts = np.unique(_pairs(_unsqueezed(row["codes"]))[1], return_counts=True)
                if not len(keys):
                    continue
                ranges = (keys >> _U64(64 - range_bits)).astype(np.int64)
                starts = np.flatnonzero(np.concatenate(([True], ranges[1:] != ranges[:-1])))
                ends = np.append(starts[1:], len(keys))
                yield pa.RecordBatch.from_pydict(
                    {
                        "lang": [row["lang"]] * len(starts),
                        "range": pa.array(ranges[starts], pa.int64()),
                        "shard": pa.array([row["shard"]] * len(starts), pa.int64()),
                        "filter": pa.array(
                            [pack_filter(keys[i:j], counts[i:j], range_bits) for i, j in zip(starts, ends)],
                            pa.binary(),
                        ),
                    }
                )

    return count


_MERGED = (
    "shard long, lang string, range long, keys binary, ids binary, "
    "found array<struct<id: long, left: long, right: long, a: long>>"
)


def _merge_of(ranges: int, min_count: int):
    """Merge the filters of one range; tell the frequent phrases, and each shard its own."""
    found_type = pa.list_(pa.struct([(n, pa.int64()) for n in ("id", "left", "right", "a")]))
    schema = pa.schema(
        [("shard", pa.int64()), ("lang", pa.string()), ("range", pa.int64())]
        + [("keys", pa.binary()), ("ids", pa.binary()), ("found", found_type)]
    )

    def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        lang, at = key[0].as_py(), key[1].as_py()
        filters = table.column("filter").to_pylist()
        keys, counts = merge_filters(filters)
        often = counts >= min_count
        keys, counts = keys[often], counts[often]
        rows = []
        if len(keys):
            ids = (np.arange(len(keys), dtype=np.int64) + 1) * ranges + at
            _small(int(ids[-1]))
            plain = restored(keys)
            left, right = plain >> _U64(32), plain & _U64(0xFFFFFFFF)
            found = [
                dict(zip(("id", "left", "right", "a"), row))
                for row in zip(ids.tolist(), left.tolist(), right.tolist(), counts.tolist())
            ]
            rows.append({"lang": lang, "range": at, "found": found})
            for shard, packed in zip(table.column("shard").to_pylist(), filters):
                place = np.searchsorted(keys, own := unpack_filter(packed)[0])
                place[place == len(keys)] = 0
                place = place[keys[place] == own]
                if len(place):
                    told = keys[place].tobytes(), ids[place].astype("<u4").tobytes()
                    rows.append({"shard": shard, "lang": lang, "range": at, "keys": told[0], "ids": told[1]})
        return pa.Table.from_pylist(rows, schema)

    return merge


def _recoded_phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard's numbers at each place become those of the phrases one word longer."""
    for batch in batches:
        for row in batch.to_pylist():
            codes = _unsqueezed(row["codes"])
            told = sorted(row["told"], key=lambda t: t["range"])
            keys = np.frombuffer(b"".join(t["keys"] for t in told), np.uint64)
            ids = np.frombuffer(b"".join(t["ids"] for t in told), "<u4")
            places, pairs = _pairs(codes)
            at = np.searchsorted(keys, pairs)
            at[at == len(keys)] = 0
            known = keys[at] == pairs
            longer = np.zeros(len(codes), np.uint32)
            longer[places[known]] = ids[at[known]]
            yield _state(row["shard"], row["lang"], longer)


def phrase_levels(
    docs: DataFrame,
    *,
    lang: str = "lang",
    text: str = "text",
    min_count: int = MIN_COUNT,
    longest: int = LONGEST,
) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n), the words a language has, and the frequent phrases by length.

    The first of the list holds (lang, id, word, a), the others (lang, id, left,
    right, a): the numbers of the phrase without its last and without its first
    word. Counts are exact.
    """
    shards = _shards(docs, lang, text)
    words = shards.select(
        "shard", "lang", F.posexplode(F.arrays_zip("words", "counts"))
    ).select(
        "shard",
        "lang",
        F.col("pos").alias("place"),
        F.col("col.words").cast("string").alias("word"),
        F.col("col.counts").alias("n"),
    )
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    range_bits = max(4, (int(total) // RANGE_WORDS).bit_length())
    frequent = _numbered_words(words, min_count)
    known = (
        words.join(frequent.select("lang", "word", "id"), ["lang", "word"])
        .groupBy("shard")
        .agg(F.collect_list(F.struct("place", "id")).alias("known"))
    )
    state = checkpointed(
        shards.select("shard", "lang", "codes").join(known, "shard").mapInArrow(_recoded_words, _STATE)
    )
    levels = [frequent]
    for length in range(2, longest + 1):
        filters = state.mapInArrow(
            _filters_of(range_bits), "lang string, range long, shard long, filter binary"
        )
        merged = checkpointed(
            filters.groupBy("lang", "range").applyInArrow(_merge_of(1 << range_bits, min_count), _MERGED)
        )
        levels.append(
            merged.where("shard IS NULL").select("lang", F.inline("found"))
        )
        if length < longest:
            told = (
                merged.where("shard IS NOT NULL")
                .groupBy("shard")
                .agg(F.collect_list(F.struct("range", "keys", "ids")).alias("told"))
            )
            state = checkpointed(state.join(told, "shard").mapInArrow(_recoded_phrases, _STATE))
    return sizes, levels


def _described(levels: list[DataFrame]) -> list[DataFrame]:
    """Per length: lang, id, phrase, last, a, and the counts of its heads and tails.

    `heads[k]` is the count of the first k + 1 words, `tails[k]` of the last k + 1.
    """
    none = F.array().cast("array<long>")
    described = [
        levels[0].select(
            "lang", "id", F.col("word").alias("phrase"), F.col("word").alias("last"), "a",
            none.alias("heads"), none.alias("tails"),
        )
    ]
    for level in levels[1:]:
        parts = described[-1]
        first = parts.select(
            "lang",
            F.col("id").alias("left"),
            F.col("phrase").alias("_phrase"),
            F.concat("heads", F.array("a")).alias("heads"),
        )
        rest = parts.select(
            "lang", F.col("id").alias("right"), "last", F.concat("tails", F.array("a")).alias("tails")
        )
        joined = level.join(first, ["lang", "left"]).join(rest, ["lang", "right"])
        described.append(
            joined.select(
                "lang", "id", F.concat_ws(" ", "_phrase", "last").alias("phrase"), "last", "a", "heads", "tails"
            )
        )
    return described


def _lowest_cut(length: int) -> Column:
    """score, k, l and r of the cut with the lowest score, the first of equal ones."""
    cuts = []
    for k in range(1, length):
        l, r = F.col("heads")[k - 1], F.col("tails")[length - k - 1]
        both = l.cast("decimal(20,0)") + r
        score = F.call_function("div", F.col("a").cast("decimal(20,0)") * F.lit(SCALE), both)
        cuts.append(F.struct(score.alias("score"), F.lit(k).alias("k"), l.alias("l"), r.alias("r")))
    return F.array_min(F.array(*cuts))


def mine_phrases(
    docs: DataFrame,
    *,
    lang: str = "lang",
    text: str = "text",
    min_count: int = MIN_COUNT,
    longest: int = LONGEST,
    covered: int = COVERED,
    top: int = TOP,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of each language.

    Counts take every word of every text. A null language is `und`; null, empty or
    wordless texts add nothing, and a table of such gives no rows. Texts of any
    length are taken whole (a text beyond a shard's size is a shard of its own);
    repeated rows count as often as they come. Ties in score go to the larger
    count, then to the phrase first in byte order. Columns beside the two read do
    not matter.

    A phrase goes where some longer frequent one has `covered` percent of its
    occurrences. It is enough to look at those one word longer: they are at
    least as frequent as what holds them.
    """
    sizes, levels = phrase_levels(docs, lang=lang, text=text, min_count=min_count, longest=longest)
    described = _described(levels)
    ranked = None
    for length in range(2, longest + 1):
        phrases = described[length - 1]
        if length < longest:
            longer = levels[length].select(
                "lang", F.explode(F.array("left", "right")).alias("id"), F.col("a").alias("_a")
            )
            most = longer.groupBy("lang", "id").agg(F.max("_a").alias("_most"))
            phrases = phrases.join(most, ["lang", "id"], "left").where(
                F.col("_most").isNull()
                | (F.col("_most").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * covered)
            )
        cut = phrases.select("lang", "phrase", "a", _lowest_cut(length).alias("_cut"))
        ranked = cut if ranked is None else ranked.union(cut)
    flat = ranked.select("lang", "phrase", "a", "_cut.l", "_cut.r", "_cut.score")
    order = F.desc("score"), F.desc("a"), F.col("phrase")
    # What is not first in its part of a language cannot be first in all of it, so
    # the last step sees a bounded number of rows.
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    within = Window.partitionBy("lang", "_part").orderBy(*order)
    few = flat.withColumn("_part", part).withColumn("rank", F.row_number().over(within)).where(F.col("rank") <= top)
    whole = Window.partitionBy("lang").orderBy(*order)
    best = few.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= top)
    return best.join(sizes, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
