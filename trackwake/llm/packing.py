"""Packing token streams into sequences, keeping their order.

The rows of an input partition form one stream of tokens. A dynamic programme
chooses where to cut it into windows of at most `length` tokens: at ends of
documents or sentences, or `length` tokens after one, inside a sentence. It
minimises padding plus penalties for cuts inside documents and sentences.
Windows are padded to `length`, except at a power of two, so a cut costs

    cost[j] = penalty[j] + min(min over i in reach: cost[i] + length - (pos[j] - pos[i]),
                               min over powers p:   cost[at pos[j] - p])

The first minimum is that of cost[i] + pos[i] over a sliding window, kept in a
monotone queue; the second looks up one cut a power. Streams are cut in blocks
of bounded size, whose last windows are taken up again by the next block.
"""

from __future__ import annotations

import json
import re
from array import array
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

LENGTH = 1024
END_ID = 0
#: What a cut costs, in tokens of padding, inside a document and inside a sentence.
SENTENCE_PENALTY = 2.0
TRUNCATION_PENALTY = 8.0
BLOCK_TOKENS = 1 << 18

_PIECE_SCHEMA = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, "
    "sequence_id long, offset long"
)
_ARROW_SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids", pa.binary()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
    ]
)

# Spaces between two characters that no one counts as white space.
_INNER_SPACE = re.compile(r"(?<=\S) (?=\S)")
_SPACES = re.compile(r"\s\s")
# Characters on whose class all versions of Unicode agree.
_PLAIN = re.compile(r"[ -~À-ÖØ-öø-ɏ\n\t]*")
# The pre-tokens of byte-level BPE where no two white spaces meet; then runs of
# them need no look ahead.
_SINGLE_SPACED = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"


class TextEncoder:
    """Token ids of whole texts by a byte-level BPE file.

    Plain texts go through the file's merges as ranks. In others, a space between
    two characters that are no white space begins a new pre-token, so the ids of
    the text are those of its words on their own; words that are not plain go
    through the file's own tokenizer, as do texts with a special token.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._whole = Tokenizer.from_file(path)
        self._special = [t["content"] for t in _file(path)["added_tokens"]]
        self._spaced = _rank_encoding(path, None)
        self._single = _rank_encoding(path, _SINGLE_SPACED)

    def _by_file(self, text: str) -> list[int]:
        return self._whole.encode(text, add_special_tokens=False).ids

    def _by_ranks(self, text: str) -> list[int]:
        encoding = self._spaced if _SPACES.search(text) else self._single
        return encoding.encode_ordinary(text)

    def encode(self, text: str) -> list[int]:
        if self._single is None or any(s in text for s in self._special):
            return self._by_file(text)
        if _PLAIN.fullmatch(text):
            return self._by_ranks(text)
        first, *rest = _INNER_SPACE.split(text)
        ids: list[int] = []
        for word in (first, *map(" ".__add__, rest)):
            plain = _PLAIN.fullmatch(word)
            ids += self._by_ranks(word) if plain else self._by_file(word)
        return ids


def _file(path: str) -> dict:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def _byte_letters() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes with."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def _vocabulary(path: str) -> dict[bytes, int]:
    letters = _byte_letters()
    vocabulary = _file(path)["model"]["vocab"]
    return {
        bytes(letters[c] for c in token): id
        for token, id in vocabulary.items()
        if all(c in letters for c in token)
    }


def _rank_encoding(path: str, pattern: str | None):
    """The file's merges as ranks; None where ids don't follow the order of merges."""
    import tiktoken
    from public_tokenizers import PATTERN

    model = _file(path)["model"]
    pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
    ids = [model["vocab"].get("".join(pair)) for pair in pairs]
    if None in ids or ids != sorted(set(ids)):
        return None
    special = {t["id"] for t in _file(path)["added_tokens"]}
    ranks = {token: id for token, id in _vocabulary(path).items() if id not in special}
    return tiktoken.Encoding(
        "ranks", pat_str=pattern or PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


@lru_cache(maxsize=2)
def text_encoder(path: str) -> TextEncoder:
    """One encoder for all tasks of a Python worker."""
    return TextEncoder(path)


@lru_cache(maxsize=2)
def sentence_ends(path: str) -> np.ndarray:
    """For each id whether its text ends a sentence or line."""
    vocabulary = _vocabulary(path)
    ends = np.zeros(max(vocabulary.values()) + 2, bool)
    for token, id in vocabulary.items():
        ends[id] = token.rstrip(b" \"')").endswith((b".", b"!", b"?", b"\n"))
    return ends


def _power_steps(positions: np.ndarray, length: int) -> tuple[list[int], list[int]]:
    """The earlier indices a power of two below `length` before each, and where its own begin."""
    later, earlier = [], []
    for k in range((length - 1).bit_length()):
        wanted = positions - (1 << k)
        at = np.searchsorted(positions, wanted)
        met = np.flatnonzero(positions[at] == wanted)
        later.append(met)
        earlier.append(at[met])
    js = np.concatenate(later) if later else np.zeros(0, np.int64)
    order = np.argsort(js, kind="stable")
    first = np.searchsorted(js[order], np.arange(len(positions) + 1))
    origins = np.concatenate(earlier)[order] if earlier else js
    return origins.tolist(), first.tolist()


def best_cuts(
    positions: np.ndarray, penalties: np.ndarray, length: int = LENGTH
) -> list[int]:
    """Indices of `positions` to cut at, the last included, the first (0) not.

    Positions rise from 0, by at most `length` at a step.
    """
    pos, fine = positions.tolist(), penalties.tolist()
    origins, own = _power_steps(positions, length)
    cost, back = [0.0] * len(pos), [0] * len(pos)
    # Front: the cut with the least cost[i] + pos[i] still in reach.
    queue = deque([(0.0, 0, 0)])
    for j in range(1, len(pos)):
        p = pos[j]
        while queue[0][1] < p - length:
            queue.popleft()
        value, _, origin = queue[0]
        least = value + length - p
        for i in origins[own[j] : own[j + 1]]:
            if cost[i] < least:
                least, origin = cost[i], i
        least += fine[j]
        cost[j], back[j] = least, origin
        value = least + p
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, p, j))
    cuts, j = [], len(pos) - 1
    while j:
        cuts.append(j)
        j = back[j]
    return cuts[::-1]


def _candidates(
    ids: np.ndarray,
    doc_ends: np.ndarray,
    ends: np.ndarray,
    length: int,
    penalties: tuple[float, float],
) -> tuple[np.ndarray, np.ndarray]:
    """Where a stream may be cut, and what each cut costs beside padding."""
    sentence = np.flatnonzero(ends[np.minimum(ids, len(ends) - 1)]) + 1
    whole = np.union1d(np.union1d(sentence, doc_ends), [0, len(ids)])
    places = np.union1d(whole, whole[whole + length < len(ids)] + length)
    gaps = np.diff(places)
    if (wide := np.flatnonzero(gaps > length)).size:
        inside = [np.arange(places[k] + length, places[k + 1], length) for k in wide]
        places = np.union1d(places, np.concatenate(inside))
    cost = np.where(np.isin(places, whole), penalties[0], penalties[1])
    cost[np.isin(places, doc_ends)] = 0.0
    return places, cost


class _Stream:
    """Packs the documents of one stream, block by block."""

    def __init__(
        self,
        ends: np.ndarray,
        base: int,
        length: int,
        penalties: tuple[float, float],
        block: int,
    ):
        self._ends, self._length, self._block = ends, length, block
        self._penalties = penalties
        self._next = base
        self._pending: list[tuple] = []  # doc_id, start, ids, doc_tokens
        self._held = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple]:
        for at in range(0, len(ids), self._block):
            part = ids[at : at + self._block]
            self._pending.append((doc_id, at, part, len(ids)))
            self._held += len(part)
            if self._held >= self._block:
                yield from self._pack(last=False)

    def finish(self) -> Iterator[tuple]:
        if self._held:
            yield from self._pack(last=True)

    def _pack(self, *, last: bool) -> Iterator[tuple]:
        ids = np.concatenate([p[2] for p in self._pending])
        borders = np.cumsum([len(p[2]) for p in self._pending])
        finished = np.array([p[1] + len(p[2]) == p[3] for p in self._pending])
        places, cost = _candidates(
            ids, borders[finished], self._ends, self._length, self._penalties
        )
        chosen = best_cuts(places, cost, self._length)
        if not last and len(chosen) > 8:
            chosen = chosen[:-4]  # the end of a block is no reason to pad
        cuts = places[chosen]
        done = int(cuts[-1])
        # A piece ends where a part of a document or a window does.
        stops = np.union1d(borders[borders <= done], cuts)
        starts = np.concatenate([[0], stops[:-1]])
        part = np.searchsorted(borders, starts, side="right")
        window = np.searchsorted(cuts, starts, side="right")
        first = np.concatenate([[0], borders])[part]
        opened = np.concatenate([[0], cuts])[window]
        for k in range(len(stops)):
            doc_id, start, own, total = self._pending[part[k]]
            a, b = int(starts[k] - first[k]), int(stops[k] - first[k])
            yield (
                doc_id,
                start + a,
                b - a,
                own[a:b].tobytes(),
                total,
                self._next + int(window[k]),
                int(starts[k] - opened[k]),
            )
        self._next += len(cuts)
        rest, at = [], 0
        for doc_id, start, own, total in self._pending:
            skip = min(max(done - at, 0), len(own))
            if skip < len(own):
                rest.append((doc_id, start + skip, own[skip:], total))
            at += len(own)
        self._pending, self._held = rest, sum(len(r[2]) for r in rest)


def pack_documents(
    docs: DataFrame,
    *,
    tokenizer: str,
    id: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    end_id: int = END_ID,
    penalties: tuple[float, float] = (SENTENCE_PENALTY, TRUNCATION_PENALTY),
    block: int = BLOCK_TOKENS,
) -> DataFrame:
    """Pieces of the documents' token ids, each id in exactly one piece.

    Columns: doc_id, start (ids of the document before the piece), length, ids
    (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset. `tokenizer`
    is the path of a tokenizer file, the same on all executors. A document is its
    ids and `end_id`; a null text is empty and so a single `end_id`. Repeated rows
    are packed as often as they come. Order within an input partition is kept; a
    sequence never holds rows of two partitions, and its id is the partition's
    number and a counter. No row is shuffled, and a task holds one block and one
    document at a time.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, ends = text_encoder(tokenizer), sentence_ends(tokenizer)
        base = TaskContext.get().partitionId() << 40
        stream = _Stream(ends, base, length, penalties, block)
        rows: list[tuple] = []

        def flush(limit: int) -> Iterator[pa.RecordBatch]:
            if len(rows) >= limit:
                columns = [
                    pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW_SCHEMA, strict=True)
                ]
                rows.clear()
                yield pa.RecordBatch.from_arrays(columns, schema=_ARROW_SCHEMA)

        for batch in batches:
            for doc_id, content in zip(batch.column(0), batch.column(1), strict=True):
                ids = array("I", encoder.encode(content.as_py() or ""))
                ids.append(end_id)
                rows.extend(stream.add(doc_id.as_py(), np.array(ids, "<u4")))
                yield from flush(2000)
        rows.extend(stream.finish())
        yield from flush(1)

    read = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return read.mapInArrow(pieces, _PIECE_SCHEMA)
