"""Masked pseudo-likelihood: how well a bidirectional window network, trained here on all
documents, predicts every token of a text from the tokens on both sides of it.

The softmax is factored by class. The ``FREQUENT`` most frequent words of all documents, A-Z
lowered, are classes of their own; every other word belongs to one of ``OTHERS`` classes by
length and ending; the text's ends are a class too. The network embeds the class before and
the class after, adds both, passes a tanh layer and a softmax over classes. What it learns
from are the counts of all triples (before, class, after) in all documents, which Spark adds
up, so training on the counts is training on every token of the corpus. With a window of one
on each side a context is a pair of classes, so the trained network is evaluated once for all
contexts and looked up.

The second factor, a word within its class, covers every word of the corpus: it comes from
``word_counts``, which counts words and their neighbours in all documents and grows with
them. A token's own occurrence is left out of those counts, so a text is never explained by
itself, but by other places that say the same. A text's score is the sum of its tokens'
log-probabilities.

Null and empty texts have no token: sum 0, mean null. Repeated rows count and are scored
each. An empty table has an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paritas.llm import texts, word_counts
from paritas.session import written

FREQUENT = 224
OTHERS = 31
#: The last token is the end of a text.
TOKENS = FREQUENT + OTHERS + 1
DIMENSION = 24
EPOCHS = 40
RATE = 0.05
#: Contexts a gradient is computed for at a time.
CONTEXTS = 8192
#: Words a task counts before it sends the counts on.
FLUSH = 1 << 20
#: Parts the triples of one task are sent in.
PARTS = 64


@dataclass(frozen=True)
class Network:
    """The frequent words by sorted hash with their tokens, the weights, and how many tokens
    and different words each of the other classes has."""

    hashes: np.ndarray
    tokens: np.ndarray
    before: np.ndarray
    after: np.ndarray
    bias: np.ndarray
    output: np.ndarray
    prior: np.ndarray
    class_tokens: np.ndarray
    class_words: np.ndarray

    @property
    def vocabulary(self) -> int:
        """Words with a probability of their own."""
        return len(self.hashes) + int(self.class_words.sum())


def _words(piece: texts.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and shape class of every word of a slice, and each text's range."""
    data = texts.lowered(piece.data)
    starts, ends, ranges = texts.words(data, piece.offsets)
    length = np.minimum(ends - starts, 10)
    last = data[ends - 1]
    plain = ((last >= ord("a")) & (last <= ord("z"))) | (last >= 128)
    kind = np.where(plain, 0, np.where(last == ord("."), 1, 2))
    shape = (length - 1) * 3 + kind
    return texts.substring_hashes(data, starts, ends), np.minimum(shape, OTHERS - 1), ranges


def _counted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts: the distinct words of up to ``FLUSH`` words at a time."""

    def flush(held: list[tuple]) -> pa.RecordBatch:
        word, first, count = np.unique(
            np.concatenate([word for word, _ in held]), return_index=True, return_counts=True
        )
        shape = np.concatenate([shape for _, shape in held])[first]
        return pa.record_batch(
            [pa.array(word.view(np.int64)), pa.array(shape.astype(np.int32)), pa.array(count)],
            names=["word", "shape", "n"],
        )

    held: list[tuple] = []
    for batch in batches:
        for piece in texts.slices(batch["text"]):
            held.append(_words(piece)[:2])
            if sum(len(word) for word, _ in held) >= FLUSH:
                yield flush(held)
                held = []
    if held:
        yield flush(held)


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, shape, n): the hash, class and count of every word of all documents."""
    counts = docs.select("text").mapInArrow(_counted_words, "word long, shape int, n long")
    return counts.groupBy("word").agg(F.min("shape").alias("shape"), F.sum("n").alias("n"))


def classes(words: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of the most frequent words, most frequent first, and how many tokens and
    different words are left in each of the other classes."""
    top = words.orderBy(F.desc("n"), "word").limit(FREQUENT).collect()
    sums = words.groupBy("shape").agg(F.sum("n").alias("n"), F.count("*").alias("words"))
    tokens, distinct = np.zeros(OTHERS, np.int64), np.zeros(OTHERS, np.int64)
    for row in sums.collect():
        tokens[row["shape"]], distinct[row["shape"]] = row["n"], row["words"]
    for row in top:
        tokens[row["shape"]] -= row["n"]
        distinct[row["shape"]] -= 1
    hashes = np.array([row["word"] for row in top], np.int64).view(np.uint64)
    return hashes, tokens, distinct


def classified(
    word: np.ndarray, shape: np.ndarray, hashes: np.ndarray, tokens: np.ndarray
) -> np.ndarray:
    """The class of every word."""
    token = FREQUENT + shape
    if len(hashes):
        at = np.searchsorted(hashes, word)
        at[at == len(hashes)] = 0
        token = np.where(hashes[at] == word, tokens[at], token)
    return token


def tokenised(
    piece: texts.Slice, hashes: np.ndarray, tokens: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of a slice's texts, the one before and after each, and each text's range."""
    word, shape, ranges = _words(piece)
    token = classified(word, shape, hashes, tokens)
    return token, *neighbours(token, ranges), ranges


def neighbours(token: np.ndarray, ranges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The token before and the token after each, or the end's."""
    before, after = np.roll(token, 1), np.roll(token, -1)
    full = np.diff(ranges) > 0
    before[ranges[:-1][full]] = TOKENS - 1
    after[ranges[1:][full] - 1] = TOKENS - 1
    return before, after


def _counted_triples(hashes: np.ndarray, tokens: np.ndarray):
    """Partial counts of (context, token), dealt by context."""

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        key, count = np.unique(np.concatenate(held), return_counts=True)
        part = (key // TOKENS) % PARTS
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(PARTS + 1))
        spans = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.record_batch(
            [
                pa.array(np.arange(PARTS, dtype=np.int32)),
                pa.array([key[s].astype(np.int32).tobytes() for s in spans], pa.binary()),
                pa.array([count[s].astype(np.int64).tobytes() for s in spans], pa.binary()),
            ],
            names=["part", "keys", "counts"],
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            for piece in texts.slices(batch["text"]):
                token, before, after, _ = tokenised(piece, hashes, tokens)
                held.append((before * TOKENS + after) * TOKENS + token)
                if sum(map(len, held)) >= FLUSH:
                    yield flush(held)
                    held = []
        if held:
            yield flush(held)

    return count


def _added(batch: pa.Table) -> pa.Table:
    """The counts of one part of the contexts, added up in a table of all its cells."""
    part = batch["part"][0].as_py()
    contexts = TOKENS * TOKENS // PARTS
    total = np.zeros(contexts * TOKENS, np.int64)
    for keys, counts in zip(batch["keys"], batch["counts"], strict=True):
        key = np.frombuffer(keys.as_py(), np.int32)
        cell = (key // TOKENS // PARTS) * TOKENS + key % TOKENS
        np.add.at(total, cell, np.frombuffer(counts.as_py(), np.int64))
    cell = np.flatnonzero(total)
    key = ((cell // TOKENS) * PARTS + part) * TOKENS + cell % TOKENS
    return pa.table({"key": pa.array(key, pa.int32()), "n": pa.array(total[cell], pa.int64())})


def triples(docs: DataFrame, hashes: np.ndarray, tokens: np.ndarray) -> DataFrame:
    """(key, n): how often each token stands in each context, over all documents. A key is
    ``(before * TOKENS + after) * TOKENS + token``; there are ``TOKENS ** 3`` at most."""
    partial = docs.select("text").mapInArrow(
        _counted_triples(hashes, tokens), "part int, keys binary, counts binary"
    )
    return partial.groupBy("part").applyInArrow(_added, "key int, n long")


def log_softmax(logits: np.ndarray) -> np.ndarray:
    top = logits.max(axis=-1, keepdims=True)
    return logits - top - np.log(np.exp(logits - top).sum(axis=-1, keepdims=True))


def train(keys: np.ndarray, counts: np.ndarray, epochs: int = EPOCHS, seed: int = 0) -> tuple:
    """Weights that maximise the counted triples' log-likelihood, by gradient steps over
    all contexts, with momentum and a scale per weight."""
    rng = np.random.default_rng(seed)
    context, token = keys // TOKENS, keys % TOKENS
    seen, row = np.unique(context, return_inverse=True)
    before, after = seen // TOKENS, seen % TOKENS
    weight = counts / max(1, counts.sum())
    target = np.zeros((len(seen), TOKENS), np.float32)
    target[row, token] = weight
    mass = target.sum(axis=1, keepdims=True)
    prior = np.log((np.bincount(token, counts, TOKENS) + 1) / (counts.sum() + TOKENS))
    shapes = [(TOKENS, DIMENSION), (TOKENS, DIMENSION), (DIMENSION,), (TOKENS, DIMENSION)]
    parts = [rng.normal(0, 0.1, shape).astype(np.float32) for shape in shapes]
    mean, square = ([np.zeros_like(p) for p in parts] for _ in range(2))
    for step in range(1, epochs + 1 if len(seen) else 1):
        e_before, e_after, bias, output = parts
        gradients = [np.zeros_like(part) for part in parts]
        for at in range(0, len(seen), CONTEXTS):
            some = slice(at, at + CONTEXTS)
            hidden = np.tanh(e_before[before[some]] + e_after[after[some]] + bias)
            logits = hidden @ output.T + prior.astype(np.float32)
            error = np.exp(log_softmax(logits)) * mass[some] - target[some]
            back = (error @ output) * (1 - hidden * hidden)
            np.add.at(gradients[0], before[some], back)
            np.add.at(gradients[1], after[some], back)
            gradients[2] += back.sum(axis=0)
            gradients[3] += error.T @ hidden
        for i, gradient in enumerate(gradients):
            mean[i] = 0.9 * mean[i] + 0.1 * gradient
            square[i] = 0.99 * square[i] + 0.01 * gradient**2
            scale = np.sqrt(square[i] / (1 - 0.99**step)) + 1e-8
            parts[i] = parts[i] - RATE * mean[i] / (1 - 0.9**step) / scale
    return (*parts, prior)


def fit(docs: DataFrame) -> Network:
    """A network trained on the tokens of all documents."""
    word, class_tokens, class_words = classes(written(vocabulary(docs), "vocabulary"))
    order = np.argsort(word, kind="stable")
    hashes, tokens = word[order], order.astype(np.int64)
    counted = written(triples(docs, hashes, tokens), "triples").toArrow()
    order = np.argsort(counted["key"].to_numpy(), kind="stable")
    keys = counted["key"].to_numpy()[order].astype(np.int64)
    weights = train(keys, counted["n"].to_numpy()[order])
    return Network(hashes, tokens, *weights, class_tokens, class_words)


def log_table(network: Network) -> np.ndarray:
    """The log-probability of every token in every context, a row per context."""
    out = np.empty((TOKENS * TOKENS, TOKENS), np.float32)
    for before in range(TOKENS):  # the contexts after one token at a time
        hidden = np.tanh(network.before[before] + network.after + network.bias)
        logits = hidden @ network.output.T + network.prior
        out[before * TOKENS : (before + 1) * TOKENS] = log_softmax(logits)
    return out


def log_likelihoods(
    docs: DataFrame,
    network: Network,
    corpus: DataFrame | None = None,
    chunk_bytes: int = word_counts.CHUNK_BYTES,
) -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, mean_log_likelihood) of every whole text.

    Words and neighbours are counted in ``corpus``, or in ``docs`` themselves, each token
    without its own occurrence. ``docs`` is read twice and must be a table that gives the
    same rows in the same order, such as a stored one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(network)
    own = 1 if corpus is None else 0

    def rare(piece: texts.Slice) -> word_counts.Classed:
        word, shape, ranges = _words(piece)
        token = classified(word, shape, shared.value.hashes, shared.value.tokens)
        return word_counts.Classed(word, token, ranges, token >= FREQUENT)

    tables: dict[str, np.ndarray] = {}

    def scored(
        ids: pa.Array, found: word_counts.Classed, seen: word_counts.Seen
    ) -> pa.RecordBatch:
        if "log" not in tables:
            tables["log"] = log_table(shared.value)
        before, after = neighbours(found.token, found.ranges)
        chance = tables["log"][before * TOKENS + after, found.token].astype(np.float64)
        group = found.token[found.rare] - FREQUENT
        class_tokens = shared.value.class_tokens[group]
        class_words = shared.value.class_words[group]
        chance[found.rare] += np.log(
            word_counts.within_class(seen, class_tokens, class_words, own)
        )
        size = np.diff(found.ranges)
        total = texts.totals(chance, found.ranges)
        return pa.record_batch(
            [
                ids,
                pa.array(size, pa.int64()),
                pa.array(total),
                pa.array(total / np.maximum(size, 1), mask=size == 0),
            ],
            names=["doc_id", "n_tokens", "log_likelihood", "mean_log_likelihood"],
        )

    return word_counts.with_counts(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"),
        corpus,
        rare,
        scored,
        "doc_id long, n_tokens long, log_likelihood double, mean_log_likelihood double",
        int(network.class_tokens.sum()),
        chunk_bytes,
    )
