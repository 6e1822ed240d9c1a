"""Quality rules by line labels: a linear-chain conditional random field marks every line
as content or boilerplate, and the share of content decides whether a document stays.

A line's features say what it consists of (words, letters, capitals, digits, symbols,
repetition), never which words. Weights and transitions are trained on labelled
documents: lines of good documents are content, lines of bad ones and repeated lines are
boilerplate. The likeliest labels are decoded by Viterbi for all documents of a slice at
once, line by line. Plain rules on counts come first: a document they fail is not kept.

Null texts have no words, so the rules fail them, and so do empty texts. Lines without a
word have no label. Without any label to learn from, all lines are content. Repeated rows
are judged each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paritas.llm import texts

WINDOW = 8
LEAST_WORDS = 20
REPEATED_PERCENT = 30
CONTENT_SHARE = 0.5
#: Labelled rows the field is trained on at most; a classifier's sample.
SAMPLE = 2000
EPOCHS = 60
RATE = 0.2
L2 = 1e-3

BOILERPLATE, CONTENT = 0, 1
FEATURES = (
    "always",
    "under 3 words",
    "under 8 words",
    "20 words or more",
    "any symbol",
    "symbols over 5 %",
    "capitals over half the letters",
    "digits over 20 %",
    "letters under 60 %",
    "equal to an earlier line",
    "ends a sentence",
    "a fifth of the words repeat the last one",
    "exclamation marks over half the words",
    "starts with a capital",
)

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[ord("A") : ord("Z") + 1] = True
_LETTER = _CAPITAL.copy()
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0") : ord("9") + 1] = True
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?"]] = True


@dataclass(frozen=True)
class Field:
    """Weights by feature and label, of the first label, and of a label after another."""

    weights: np.ndarray
    first: np.ndarray
    follows: np.ndarray


@dataclass(frozen=True)
class Lines:
    """The lines with a word of a slice: features, bytes, and each text's range."""

    features: np.ndarray
    size: np.ndarray
    ranges: np.ndarray


def _repeated(owner: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which items have an equal earlier one in their text, and which any equal one."""
    order = np.lexsort((np.arange(len(values)), values, owner))
    same = (owner[order][1:] == owner[order][:-1]) & (values[order][1:] == values[order][:-1])
    later, either = np.zeros(len(values), bool), np.zeros(len(values), bool)
    later[order[1:][same]] = True
    either[order[1:][same]] = True
    either[order[:-1][same]] = True
    return later, either


def examined(piece: texts.Slice) -> tuple[dict[str, np.ndarray], Lines]:
    """The rules' counts of each text of a slice, and its lines."""
    data, offsets = piece.data, piece.offsets
    starts, ends, ranges = texts.words(data, offsets)
    hashes = texts.substring_hashes(data, starts, ends)
    windows, owner, first = texts.ngrams(hashes, ranges, WINDOW)
    _, twice = _repeated(owner, windows)
    cover = np.zeros(len(starts) + 1, np.int64)
    np.add.at(cover, first[twice], 1)
    np.add.at(cover, first[twice] + WINDOW, -1)
    covered = np.cumsum(cover[:-1]) > 0
    sizes = ends - starts
    extra = ((data & 0xC0) == 0x80).astype(np.int64)

    breaks = np.zeros(len(data), bool)
    breaks[data == 0x0A] = True
    line_starts, line_ends = texts.runs(~breaks, offsets)
    word_cuts = np.searchsorted(starts, np.append(line_starts, len(data)))
    n_words = np.searchsorted(starts, line_ends) - word_cuts[:-1]
    full = n_words > 0
    line_starts, line_ends, n_words = line_starts[full], line_ends[full], n_words[full]
    first_word = word_cuts[:-1][full]
    line_ranges = np.searchsorted(line_starts, offsets)
    later, _ = _repeated(
        texts.owners(line_ranges), texts.substring_hashes(data, line_starts, line_ends)
    )
    counts = {
        "n_words": np.diff(ranges),
        "word_chars": texts.totals(sizes, ranges) - texts.totals(extra, offsets),
        "n_symbols": texts.totals(_SYMBOL[data].astype(np.int64), offsets),
        "n_dup_lines": texts.totals(later.astype(np.int64), line_ranges),
        "n_repeat_words": texts.totals(covered.astype(np.int64), ranges),
    }

    def in_line(table: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(table[data])])
        return sums[line_ends] - sums[line_starts]

    again = np.zeros(len(hashes) + 1, np.int64)
    again[2:] = np.cumsum(hashes[1:] == hashes[:-1])
    echoes = again[first_word + n_words] - again[np.minimum(first_word + 1, len(hashes))]
    size = line_ends - line_starts
    letters, symbols = in_line(_LETTER), in_line(_SYMBOL)
    marks = in_line(np.arange(256) == ord("!"))
    last = ends[first_word + n_words - 1] - 1
    columns = [
        np.ones(len(size), bool),
        n_words < 3,
        n_words < 8,
        n_words >= 20,
        symbols > 0,
        symbols * 20 > size,
        in_line(_CAPITAL) * 2 > letters,
        in_line(_DIGIT) * 5 > size,
        letters * 10 < size * 6,
        later,
        _ENDS[data[last]],
        echoes * 5 >= n_words,
        marks * 2 > n_words,
        _CAPITAL[data[starts[first_word]]],
    ]
    features = np.stack(columns, axis=1) if len(size) else np.zeros((0, len(FEATURES)), bool)
    return counts, Lines(features, size, line_ranges)


def _steps(ranges: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For the first line of all texts, the second, and so on: texts, and their lines.

    Texts are taken by falling number of lines, so those of a step are a beginning of
    those of the step before.
    """
    sizes = np.diff(ranges)
    order = np.argsort(-sizes, kind="stable")
    left = np.searchsorted(-sizes[order], -np.arange(1, sizes.max(initial=0) + 1), "right")
    for step, count in enumerate(left):
        texts_ = order[:count]
        yield texts_, ranges[texts_] + step


def viterbi(emission: np.ndarray, ranges: np.ndarray, field: Field) -> np.ndarray:
    """The likeliest label of every line, given its scores by label."""
    best = np.zeros((len(ranges) - 1, 2))
    back = np.zeros((len(emission), 2), np.int8)
    at = None
    for which, lines in _steps(ranges):
        if at is None:
            best[which] = field.first + emission[lines]
        else:
            paths = best[which][:, :, None] + field.follows
            back[lines] = paths.argmax(axis=1)
            best[which] = paths.max(axis=1) + emission[lines]
        at = which
    labels = np.zeros(len(emission), np.int8)
    state = best.argmax(axis=1).astype(np.int8)
    for which, lines in reversed(list(_steps(ranges))):
        labels[lines] = state[which]
        state[which] = back[lines, state[which]]
    return labels


def _log_sum(values: np.ndarray, axis: int) -> np.ndarray:
    top = values.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(values - top).sum(axis=axis))


def _marginals(
    emission: np.ndarray, ranges: np.ndarray, field: Field
) -> tuple[np.ndarray, np.ndarray, float]:
    """Chances of each line's label and, summed over all texts, of each pair of neighbours;
    and the logarithm of the partition functions."""
    steps = list(_steps(ranges))
    forward, backward = np.zeros_like(emission), np.zeros_like(emission)
    for i, (_, lines) in enumerate(steps):
        if i == 0:
            forward[lines] = field.first + emission[lines]
        else:
            paths = forward[lines - 1][:, :, None] + field.follows
            forward[lines] = _log_sum(paths, 1) + emission[lines]
    for _, lines in reversed(steps[1:]):
        ahead = (backward[lines] + emission[lines])[:, None, :] + field.follows
        backward[lines - 1] = _log_sum(ahead, 2)
    ends = ranges[1:][np.diff(ranges) > 0] - 1
    total = np.zeros(len(ranges) - 1)
    total[np.diff(ranges) > 0] = _log_sum(forward[ends], 1)
    own = total[texts.owners(ranges)]
    pairs = np.zeros((2, 2))
    for _, lines in steps[1:]:
        joint = (
            forward[lines - 1][:, :, None]
            + field.follows
            + (emission[lines] + backward[lines])[:, None, :]
            - own[lines][:, None, None]
        )
        pairs += np.exp(joint).sum(axis=0)
    return np.exp(forward + backward - own[:, None]), pairs, float(total.sum())


def train(
    features: np.ndarray, labels: np.ndarray, ranges: np.ndarray, epochs: int = EPOCHS
) -> Field:
    """Maximum likelihood with an L2 penalty, by gradient steps with momentum and a scale
    per weight."""
    x = features.astype(np.float64)
    parts = [np.zeros((x.shape[1], 2)), np.zeros(2), np.zeros((2, 2))]
    if not len(x):
        parts[1][CONTENT] = 1.0
        return Field(*parts)
    gold = np.eye(2)[labels]
    begins = ranges[:-1][np.diff(ranges) > 0]
    inner = np.setdiff1d(np.arange(len(x)), begins)
    gold_pairs = gold[inner - 1].T @ gold[inner]
    mean = [np.zeros_like(p) for p in parts]
    square = [np.zeros_like(p) for p in parts]
    for step in range(1, epochs + 1):
        field = Field(*parts)
        chance, pairs, _ = _marginals(x @ field.weights, ranges, field)
        gradients = [
            x.T @ (chance - gold),
            (chance - gold)[begins].sum(axis=0),
            pairs - gold_pairs,
        ]
        for i, gradient in enumerate(gradients):
            gradient = gradient / len(x) + L2 * parts[i]
            mean[i] = 0.9 * mean[i] + 0.1 * gradient
            square[i] = 0.99 * square[i] + 0.01 * gradient**2
            scale = np.sqrt(square[i] / (1 - 0.99**step)) + 1e-8
            parts[i] = parts[i] - RATE * mean[i] / (1 - 0.9**step) / scale
    return Field(*parts)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in texts.slices(batch["text"]):
            _, lines = examined(piece)
            spans = zip(lines.ranges[:-1], lines.ranges[1:], strict=True)
            part = batch.slice(piece.first, piece.rows)
            rows = [lines.features[a:b].astype(np.uint8).tobytes() for a, b in spans]
            yield pa.record_batch(
                [part["key"], part["label"], pa.array(rows, pa.binary())],
                names=["key", "label", "lines"],
            )


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field:
    """A field learned from at most ``sample`` documents with a quality label, those whose
    id has the smallest hash. Only their lines' features reach the driver."""
    ids = (
        labels.where("quality in (0, 1) and doc_id is not null")
        .groupBy(F.col("doc_id").alias("key"))
        .agg(F.min("quality").cast("int").alias("label"))
        .orderBy(F.xxhash64("key"), "key")
        .limit(sample)
    )
    rows = (
        docs.select(F.col("doc_id").alias("key"), "text")
        .join(F.broadcast(ids), "key")
        .mapInArrow(_packed, "key long, label int, lines binary")
        .collect()
    )
    rows.sort(key=lambda row: (row.key, row.lines))
    width = len(FEATURES)
    features = [np.frombuffer(row.lines, np.uint8).reshape(-1, width) for row in rows]
    ranges = np.concatenate([[0], np.cumsum([len(f) for f in features])]).astype(np.int64)
    x = np.concatenate([np.zeros((0, width), np.uint8), *features])
    good = np.repeat([row.label for row in rows], np.diff(ranges)) if rows else np.zeros(0)
    repeats = x[:, FEATURES.index("equal to an earlier line")] == 1
    return train(x, np.where((good == 1) & ~repeats, CONTENT, BOILERPLATE), ranges)


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def line_verdicts(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, n_lines, content_share) of every document, from its whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in texts.slices(batch["text"]):
                counts, lines = examined(piece)
                labels = viterbi(lines.features @ shared.value.weights, lines.ranges, shared.value)
                content = texts.totals(lines.size * (labels == CONTENT), lines.ranges)
                whole = texts.totals(lines.size, lines.ranges)
                yield pa.record_batch(
                    [
                        batch["doc_id"].slice(piece.first, piece.rows),
                        *(pa.array(counts[name], pa.int64()) for name in _COUNTS),
                        pa.array(np.diff(lines.ranges), pa.int64()),
                        pa.array(content / np.maximum(whole, 1)),
                    ],
                    names=["doc_id", *_COUNTS, "n_lines", "content_share"],
                )

    schema = ", ".join(f"{name} long" for name in ("doc_id", *_COUNTS, "n_lines"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        judged, f"{schema}, content_share double"
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words")
    )
    kept = ~failed & (F.col("content_share") >= CONTENT_SHARE)
    return rows.select(
        "doc_id",
        *_COUNTS,
        failed.alias("base_failed"),
        kept.alias("kept"),
        "n_lines",
        "content_share",
    )
