"""How often words and pairs of neighbours stand in all documents, for words in classes.

Documents are cut into chunks of whole texts. A chunk asks once for each of its keys: a word,
a pair of neighbours, a neighbour with a class. Keys are dealt by hash to parts whose number
follows from the tokens of the corpus, so a part stays bounded; it adds up what all chunks
sent and answers each of them. The answers meet their chunk's texts again, in one group per
chunk. What travels are packed hashes, once per chunk, so a pair that stands in every line is
one key of a chunk like any other; texts travel once.

A key is known by its part and 40 more bits. A part holds ``PART_KEYS`` keys or so at every
size of the corpus, so about one key in 500,000 shares its count with another.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paritas.llm import texts

#: Bytes of text in a chunk; a longer text is a chunk of its own.
CHUNK_BYTES = 3 << 20
#: Keys a part is meant for.
PART_KEYS = 1 << 21
#: Bytes of a key besides its part.
KEY_BYTES = 5
#: Occurrences of a neighbour that weigh as much as the class alone.
STRENGTH = 2.0
#: What stands before the first and after the last word.
END = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)

ASKED = "chunk long, part int, keys binary, counts binary"


@dataclass
class Classed:
    """The words of a chunk by hash and class, each text's range, and which are asked for."""

    word: np.ndarray
    token: np.ndarray
    ranges: np.ndarray
    rare: np.ndarray


@dataclass
class Seen:
    """For each word asked for: how often it stands in the corpus, with the word before and
    the word after it, and how often these stand beside its class."""

    word: np.ndarray
    left: np.ndarray
    right: np.ndarray
    left_class: np.ndarray
    right_class: np.ndarray


def within_class(
    seen: Seen, class_tokens: np.ndarray, class_words: np.ndarray, own: int
) -> np.ndarray:
    """The probability of each word within its class, from both neighbours. ``own``
    occurrences of the word itself are left out."""
    alone = (seen.word - own + 1) / (class_tokens - own + class_words + 1)
    left = (seen.left - own + STRENGTH * alone) / (seen.left_class - own + STRENGTH)
    right = (seen.right - own + STRENGTH * alone) / (seen.right_class - own + STRENGTH)
    return (left + right) / 2


def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return texts.mix(first * _BASE + second)


def keys(found: Classed) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All keys of a chunk, one per occurrence, and where in them each rare word's pair with
    the word before and after it is. The keys start with the rare words, their classes with
    the word before, and their classes with the word after."""
    full = np.diff(found.ranges) > 0
    starts = found.ranges[:-1][full]
    line = np.append(np.insert(found.word, starts, END), END)
    asked = np.append(np.insert(found.rare, starts, False), False)
    pairs = _pair(line[:-1], line[1:])
    kept = asked[:-1] | asked[1:]
    place = np.cumsum(kept) - 1
    at = np.flatnonzero(asked)
    group = texts.mix(found.token[found.rare].astype(np.uint64) + np.uint64(1))
    rare = found.word[found.rare]
    out = np.concatenate(
        [rare, _pair(line[at - 1], group), _pair(group, line[at + 1]), pairs[kept]]
    )
    return out, 3 * len(rare) + place[at - 1], 3 * len(rare) + place[at]


def _chunks(
    batches: Iterator[pa.RecordBatch], limit: int
) -> Iterator[tuple[int, pa.Table]]:
    """Consecutive whole rows in chunks, with a number that is the same at every reading."""
    number = TaskContext.get().partitionId() << 32
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for piece in texts.slices(batch["text"], limit):
            if held and size + len(piece.data) > limit:
                yield number, pa.Table.from_batches(held)
                number, held, size = number + 1, [], 0
            held.append(batch.slice(piece.first, piece.rows))
            size += len(piece.data)
    if held:
        yield number, pa.Table.from_batches(held)


def _piece(column: pa.ChunkedArray) -> texts.Slice:
    """All texts of a chunk as one slice."""
    whole = pa.concat_arrays([part.cast(pa.large_string()) for part in column.chunks])
    return next(texts.slices(whole, 1 << 62))


def _packed(values: np.ndarray, width: int) -> bytes:
    """Byte planes: sorted or small values then compress well."""
    return values.view(np.uint8).reshape(-1, values.itemsize)[:, :width].T.tobytes()


def _unpacked(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view(np.uint64).ravel()


def _asking(
    classed: Callable, bits: int, chunk_bytes: int, chunked: bool, counted: bool
) -> Callable:
    """What each chunk asks of each part, and what it adds to it. Chunks that are not scored
    ask nothing and have no number."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, chunk in _chunks(batches, chunk_bytes):
            wanted, n = np.unique(keys(classed(_piece(chunk["text"])))[0], return_counts=True)
            if not counted:
                n = np.zeros_like(n)
            part = (wanted >> np.uint64(64 - bits)).astype(np.int64)
            cuts = np.searchsorted(part, np.arange((1 << bits) + 1))
            used = np.flatnonzero(np.diff(cuts))
            spans = [slice(cuts[p], cuts[p + 1]) for p in used]
            short = (wanted << np.uint64(bits)) >> np.uint64(64 - 8 * KEY_BYTES)
            yield pa.record_batch(
                [
                    pa.array([number if chunked else None] * len(used), pa.int64()),
                    pa.array(used, pa.int32()),
                    pa.array([_packed(short[s], KEY_BYTES) for s in spans], pa.binary()),
                    pa.array([_packed(n[s].astype(np.uint64), 8) for s in spans], pa.binary()),
                ],
                names=["chunk", "part", "keys", "counts"],
            )

    return ask


def _answered(table: pa.Table) -> pa.Table:
    """The totals of one part, for each chunk that asks in its order."""
    asked = [_unpacked(value.as_py(), KEY_BYTES) for value in table["keys"]]
    counts = np.concatenate([_unpacked(value.as_py(), 8) for value in table["counts"]])
    _, place = np.unique(np.concatenate(asked), return_inverse=True)
    total = np.zeros(place.max() + 1, np.uint64)
    np.add.at(total, place, counts)
    ends = np.cumsum([len(one) for one in asked])
    answers = [
        _packed(total[place[end - len(one) : end]], 8)
        for one, end in zip(asked, ends, strict=True)
    ]
    out = pa.table(
        [table["chunk"], table["part"], pa.array(answers, pa.binary())],
        names=["chunk", "part", "data"],
    )
    return out.filter(out["chunk"].is_valid())


def _carrying(chunk_bytes: int) -> Callable:
    """The rows of each chunk in one value."""

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, chunk in _chunks(batches, chunk_bytes):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, chunk.schema) as out:
                out.write_table(chunk)
            data = sink.getvalue().to_pybytes()
            yield pa.record_batch(
                [pa.array([number]), pa.array([data], pa.binary())], names=["chunk", "rows"]
            )

    return carry


def with_counts(
    docs: DataFrame,
    corpus: DataFrame | None,
    classed: Callable[[texts.Slice], Classed],
    scored: Callable[[pa.Array, Classed, Seen], pa.RecordBatch],
    schema: str,
    tokens: int,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """``scored`` of every chunk of ``docs`` (doc_id, text), given what the whole ``corpus``,
    by default ``docs``, says about its words. ``tokens`` is the number of rare tokens."""
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, 3 * tokens // PART_KEYS)
    bits = min(64 - 8 * KEY_BYTES, max(1, (parts - 1).bit_length()))

    asked = docs.mapInArrow(_asking(classed, bits, chunk_bytes, True, corpus is None), ASKED)
    if corpus is not None:
        told = corpus.select(F.lit(None).cast("long").alias("doc_id"), "text")
        asked = asked.union(told.mapInArrow(_asking(classed, bits, chunk_bytes, False, True), ASKED))
    answers = asked.groupBy("part").applyInArrow(_answered, "chunk long, part int, data binary")
    carried = docs.mapInArrow(_carrying(chunk_bytes), "chunk long, rows binary")

    def score(rows: pa.Table, answer: pa.Table) -> pa.Table:
        if len(rows) != 1:
            raise ValueError("documents changed between two readings")
        chunk = pa.ipc.open_stream(rows["rows"][0].as_py()).read_all()
        found = classed(_piece(chunk["text"]))
        wanted, left, right = keys(found)
        distinct, place = np.unique(wanted, return_inverse=True)
        totals = [_unpacked(d.as_py(), 8) for d in answer.sort_by("part")["data"]]
        total = np.concatenate([np.zeros(0, np.uint64), *totals]).astype(np.float64)
        if len(total) != len(distinct):
            raise ValueError("documents changed between two readings")
        n, rare = total[place], int(found.rare.sum())
        seen = Seen(n[:rare], n[left], n[right], n[rare : 2 * rare], n[2 * rare : 3 * rare])
        ids = chunk["doc_id"].combine_chunks()
        return pa.Table.from_batches([scored(ids, found, seen)])

    # Each side has a stage of its own, so a chunk's number is that of its partition of docs.
    both = carried.groupBy("chunk").cogroup(answers.groupBy("chunk"))
    return both.applyInArrow(score, schema)
