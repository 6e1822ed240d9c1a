"""SentencePiece encoding and decoding: batched Viterbi in NumPy.

A text is the best-scoring sequence of pieces of a given vocabulary. Spaces are the
letter ``▁`` and, where the model asks for it, one stands before the text. No piece has
``▁`` after another letter, so the text falls into words, each a run of ``▁`` and what
follows, and the best sequence of a text is that of its words. Equal words of a slice are
encoded once. Words of one length advance together: for every end and every start before
it the hash of the substring is looked up among the sorted hashes of the pieces, and the
best sum so far and its start are kept for all words at once.

A character no piece covers becomes its UTF-8 bytes, at less than the worst piece's
score. Models whose scores are merge ranks, not log-probabilities, say nothing about sums;
for these a piece's score is its log-probability under Zipf's law at its rank.

Decoding joins the pieces, reads byte pieces as bytes and takes the added ``▁`` away, so
it returns the text exactly, whatever it holds. Null stays null; an empty text has no
pieces. Texts that hold the letter ``▁`` itself come back with spaces in its place, as in
any SentencePiece model; ``round_trip`` compares with that. Repeated rows are encoded
each, extra columns ignored or kept as the function says.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from paritas.llm import texts

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text whose equal words are encoded once.
SLICE_BYTES = 1 << 20
#: Substrings looked up at a time.
LOOKUPS = 1 << 18
#: How much worse than the worst piece a character without piece scores.
UNKNOWN = 10.0
#: A score below this is no log-probability but a rank.
RANKS_BELOW = -1000.0
#: Entries of the table that tells which hashes are worth a search.
LIKELY = 1 << 20


@dataclass(frozen=True)
class Vocabulary:
    """Sorted piece hashes with ids and scores, and each id's bytes; ``▁`` is a space."""

    hashes: np.ndarray
    #: Whether some piece's hash ends in these bits; spares most searches.
    likely: np.ndarray
    ids: np.ndarray
    scores: np.ndarray
    longest: int
    byte_ids: np.ndarray
    content: list[bytes]
    unknown: float
    prefix: bool


def vocabulary(
    pieces: list[str], scores: list[float], byte_ids: list[int], skipped: set[int], prefix: bool
) -> Vocabulary:
    """``byte_ids`` are the ids of the bytes 0 to 255; ``skipped`` ids are never used."""
    content = [piece.replace("▁", " ").encode() for piece in pieces]
    for value, i in enumerate(byte_ids):
        content[i] = bytes([value])
    for i in skipped:
        content[i] = b""
    if any(" " in text.lstrip(b" ").decode("utf-8", "replace") for text in content if len(text) > 1):
        raise ValueError("a piece spans words")
    normal = [i for i in range(len(pieces)) if i not in skipped and i not in set(byte_ids)]
    values = np.array([scores[i] for i in normal])
    if values.min(initial=0.0) < RANKS_BELOW:
        ranks = np.argsort(np.argsort(-values, kind="stable")).astype(np.float64)
        values = -np.log((ranks + 2.7) * np.log(len(values) + 2.0))
    lengths = np.array([len(content[i]) for i in normal], np.int64)
    ends = np.cumsum(lengths)
    data = np.frombuffer(b"".join(content[i] for i in normal), np.uint8)
    hashes = texts.substring_hashes(data, ends - lengths, ends)
    order = np.argsort(hashes, kind="stable")
    likely = np.zeros(LIKELY, bool)
    likely[hashes & np.uint64(LIKELY - 1)] = True
    return Vocabulary(
        hashes[order],
        likely,
        np.array(normal, np.int32)[order],
        values[order],
        int(lengths.max(initial=0)),
        np.array(byte_ids, np.int32),
        content,
        float(values.min(initial=0.0)) - UNKNOWN,
        prefix,
    )


def load(path: str = MODEL) -> Vocabulary:
    """The vocabulary of a model file with byte pieces, read on the driver."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    count = len(model)
    byte_ids = {int(model.id_to_piece(i)[1:-1], 16): i for i in range(count) if model.is_byte(i)}
    if len(byte_ids) != 256:
        raise ValueError(f"{path} has no byte pieces, so not every text could be encoded")
    skipped = {
        i for i in range(count) if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
    }
    return vocabulary(
        [model.id_to_piece(i) for i in range(count)],
        [model.get_score(i) for i in range(count)],
        [byte_ids[value] for value in range(256)],
        skipped,
        model.encode("a", out_type=str)[0].startswith("▁"),
    )


def _tokens(letters: np.ndarray, words: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the best sequences of words of one length, end to end, and how many each
    word has. ``letters`` has a row of bytes per word."""
    count, length = letters.shape
    up, down = texts.powers(length + 1)
    sums = np.zeros((count, length + 1), np.uint64)
    np.cumsum(texts.BYTE_VALUES[letters] * up[:length], axis=1, out=sums[:, 1:])
    begins = np.ones((count, length + 1), bool)
    begins[:, 1:length] = (letters[:, 1:] & 0xC0) != 0x80
    best = np.full((count, length + 1), -np.inf)
    best[:, 0] = 0.0
    since = np.zeros((count, length + 1), np.int32)
    piece = np.full((count, length + 1), -1, np.int32)
    rows, last = np.arange(count), np.zeros(count, np.int64)
    for end in range(1, length + 1):
        low = max(0, end - words.longest)
        width = (end - np.arange(low, end)).astype(np.uint64)
        found = texts.mix((sums[:, end, None] - sums[:, low:end]) * down[low:end] + width)
        likely = words.likely[found & np.uint64(len(words.likely) - 1)]
        where = np.flatnonzero(likely & (best[:, low:end] > -np.inf))
        at = np.searchsorted(words.hashes, found.ravel()[where])
        at[at == len(words.hashes)] = 0
        hit = words.hashes[at] == found.ravel()[where]
        where, at = where[hit], at[hit]
        total = np.full(found.shape, -np.inf)
        total.ravel()[where] = best[:, low:end].ravel()[where] + words.scores[at]
        index = np.zeros(found.shape, np.int32)
        index.ravel()[where] = at
        start = np.argmax(total, axis=1)
        most = total[rows, start]
        alone = best[rows, last] + words.unknown
        use = most >= alone
        ends = begins[:, end]
        best[:, end] = np.where(ends, np.where(use, most, alone), -np.inf)
        since[:, end] = np.where(use, start + low, last)
        piece[:, end] = np.where(use, words.ids[index[rows, start]], -1)
        last = np.where(ends, end, last)
    return _traced(letters, since, piece, words)


def _traced(
    letters: np.ndarray, since: np.ndarray, piece: np.ndarray, words: Vocabulary
) -> tuple[np.ndarray, np.ndarray]:
    """Follow the backpointers of all words at once; an id stands where its piece starts."""
    count, length = letters.shape
    out = np.full((count, length), -1, np.int32)
    rows = np.arange(count)
    end = np.full(count, length, np.int64)
    while len(rows):
        start, ids = since[rows, end], piece[rows, end]
        known = ids >= 0
        out[rows[known], start[known]] = ids[known]
        byte, row, stop = start[~known].astype(np.int64), rows[~known], end[~known]
        while len(row):
            out[row, byte] = words.byte_ids[letters[row, byte]]
            byte = byte + 1
            more = byte < stop
            byte, row, stop = byte[more], row[more], stop[more]
        more = start > 0
        rows, end = rows[more], start[more].astype(np.int64)
    used = out >= 0
    return out[used], used.sum(axis=1)


def _gathered(flat: np.ndarray, lengths: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The pieces ``which`` of ``flat``, cut into ``lengths``, end to end."""
    starts = np.cumsum(lengths) - lengths
    size = lengths[which]
    ends = np.cumsum(size)
    shift = np.repeat(starts[which] - (ends - size), size)
    return flat[shift + np.arange(len(shift))]


def _spaced(piece: texts.Slice, words: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The slice with a space before each text that has any byte, if the model wants it."""
    if not words.prefix:
        return piece.data, piece.offsets
    full = np.diff(piece.offsets) > 0
    data = np.insert(piece.data, piece.offsets[:-1][full], 0x20)
    return data, piece.offsets + np.concatenate([[0], np.cumsum(full)])


def encoded(piece: texts.Slice, words: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a slice's texts, end to end, and each text's range of them."""
    data, offsets = _spaced(piece, words)
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(piece.rows + 1, np.int64)
    space = data == 0x20
    begin = space.copy()
    begin[1:] &= ~space[:-1]
    begin[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(begin)
    ends = np.append(starts[1:], len(data))
    hashes = texts.substring_hashes(data, starts, ends)
    _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    size = (ends - starts)[first]
    order = np.argsort(size, kind="stable")
    cuts = np.flatnonzero(np.diff(size[order], prepend=-1))
    ids, counts = [np.zeros(0, np.int32)], np.zeros(len(first), np.int64)
    for a, b in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
        length = int(size[order[a]])
        step = max(1, LOOKUPS // max(1, min(length, words.longest)))
        for at in range(a, b, step):
            some = order[at : min(at + step, b)]
            letters = data[starts[first[some]][:, None] + np.arange(length)]
            flat, counts[some] = _tokens(letters, words)
            ids.append(flat)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    flat = _gathered(np.concatenate(ids), counts[order], rank[which])
    ends_of = np.concatenate([[0], np.cumsum(counts[which])])
    return flat, ends_of[np.searchsorted(starts, offsets)]


def decoded(
    ids: np.ndarray, ranges: np.ndarray, words: Vocabulary
) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts, end to end, and where each starts and ends."""
    lengths = np.array([len(content) for content in words.content], np.int64)
    flat = np.frombuffer(b"".join(words.content), np.uint8)
    data = _gathered(flat, lengths, ids)
    at = np.concatenate([[0], np.cumsum(lengths[ids])])[ranges]
    if words.prefix:
        full = np.diff(at) > 0
        data = np.delete(data, at[:-1][full])
        at = at - np.concatenate([[0], np.cumsum(full)])
    return data, at


def _plain(column: pa.Array) -> pa.Array:
    return pc.replace_substring(column, "\u2581", " ")


def _with_columns(docs: DataFrame, schema: str, column: str, make: Callable) -> DataFrame:
    """The table with further columns, made slice by slice from a text column, so that a
    task holds a batch and the results of one slice."""
    new = StructType.fromDDL(schema)
    kept = [name for name in docs.columns if name not in new.names]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in texts.slices(_plain(batch[column]), SLICE_BYTES):
                part = batch.slice(piece.first, piece.rows)
                arrays = make(piece, part[column].is_null())
                yield pa.record_batch(
                    [*(part[name] for name in kept), *arrays], names=[*kept, *new.names]
                )

    rows = docs.select(*kept, *([column] if column not in kept else []))
    return rows.mapInArrow(made, StructType([*docs.select(*kept).schema, *new]))


def _lists(ids: np.ndarray, ranges: np.ndarray, null: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ranges, pa.int32()), pa.array(ids), mask=null)


def with_pieces(
    docs: DataFrame, words: Vocabulary, column: str = "text", name: str = "pieces"
) -> DataFrame:
    """The table and ``name``, the ids of ``column``."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def make(piece: texts.Slice, null: pa.Array) -> list[pa.Array]:
        return [_lists(*encoded(piece, shared.value), null)]

    return _with_columns(docs, f"{name} array<int>", column, make)


def with_text(
    docs: DataFrame, words: Vocabulary, column: str = "pieces", name: str = "text"
) -> DataFrame:
    """The table and ``name``, the text that the ids of ``column`` spell."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    @F.arrow_udf("string")
    def decode(column: pa.Array) -> pa.Array:
        parts = []
        ranges = np.asarray(column.offsets, np.int64)
        first = 0
        while first < len(column):
            last = int(np.searchsorted(ranges, ranges[first] + SLICE_BYTES, "right")) - 1
            last = min(max(last, first + 1), len(column))
            ids = np.asarray(column.values)[ranges[first] : ranges[last]]
            own = ranges[first : last + 1] - ranges[first]
            data, at = decoded(ids, own, shared.value)
            valid = np.asarray(column.slice(first, last - first).is_valid())
            parts.append(
                pa.StringArray.from_buffers(
                    last - first,
                    pa.py_buffer(at.astype(np.int32)),
                    pa.py_buffer(data),
                    pa.py_buffer(np.packbits(valid, bitorder="little").tobytes()),
                    int((~valid).sum()),
                )
            )
            first = last
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return docs.withColumn(name, decode(column))


def _checked(piece: texts.Slice, words: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of a slice, each text's range, and whether decoding returns the text."""
    ids, ranges = encoded(piece, words)
    data, at = decoded(ids, ranges, words)
    if np.array_equal(at, piece.offsets):
        wrong = np.concatenate([[0], np.cumsum(data != piece.data)])
        return ids, ranges, wrong[at[1:]] == wrong[at[:-1]]
    spans = zip(at[:-1], at[1:], piece.offsets[:-1], piece.offsets[1:], strict=True)
    same = [np.array_equal(data[a:b], piece.data[c:d]) for a, b, c, d in spans]
    return ids, ranges, np.array(same, bool)


def _prints(ids: np.ndarray, ranges: np.ndarray) -> np.ndarray:
    """A hash of each text's ids and their places."""
    place = np.arange(len(ids)) - ranges[:-1][texts.owners(ranges)]
    value = texts.mix(ids.astype(np.uint64) << np.uint64(32) | place.astype(np.uint64))
    sums = np.zeros(len(ids) + 1, np.uint64)
    np.cumsum(value, out=sums[1:])
    return (sums[ranges[1:]] - sums[ranges[:-1]]).view(np.int64)


def round_trip(docs: DataFrame, words: Vocabulary) -> DataFrame:
    """(doc_id, pieces, n_pieces, n_bytes, pieces_print, round_trip) of every document: its
    ids, how many, the bytes of its text, a hash of the ids, and whether decoding them
    returns the text. A null text has null for ids."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def make(piece: texts.Slice, null: pa.Array) -> list[pa.Array]:
        ids, ranges, same = _checked(piece, shared.value)
        counts = [np.diff(ranges), np.diff(piece.offsets), _prints(ids, ranges)]
        sizes = (pa.array(c, pa.int64()) for c in counts)
        return [_lists(ids, ranges, null), *sizes, pa.array(same)]

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = (
        "pieces array<int>, n_pieces long, n_bytes long, pieces_print long, round_trip boolean"
    )
    return _with_columns(rows, schema, "text", make).drop("text")


def verified(docs: DataFrame, words: Vocabulary) -> DataFrame:
    """The documents and their ``pieces``; a text that decoding does not return is an
    error, so what is written is known to be complete."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def make(piece: texts.Slice, null: pa.Array) -> list[pa.Array]:
        ids, ranges, same = _checked(piece, shared.value)
        if not same.all():
            raise ValueError("pieces differ from their text")
        return [_lists(ids, ranges, null)]

    return _with_columns(docs, "pieces array<int>", "text", make)
