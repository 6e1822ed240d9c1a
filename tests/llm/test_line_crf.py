"""Rules against plain Python, the field against brute force over all label sequences."""

import itertools
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from paritas.llm import line_crf as L

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = set()
    for i, window in enumerate(windows):
        if windows.count(window) > 1:
            covered.update(range(i, i + 8))
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    dup = sum(line in lines[:i] for i, line in enumerate(lines))
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    n = len(words)
    failed = n < 20 or 100 * len(covered) > 30 * n
    return n, sum(map(len, words)), symbols, dup, len(covered), failed


TEXTS = [
    None,
    "",
    "\n\n",
    "one",
    "a b c d e f g h a b c d e f g h",
    "x " * 100,
    " same line\nsame line\n same line\nother\n\n",
    "é日本 🙂 # * $ % & | < >\r\nnext\x0bword",
    "\n".join(f"line {i} of a text with some words in it." for i in range(30)),
    "A B. " * 9 + "\n" + "A B. " * 9,
]


def test_rules_on_odd_texts(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, TEXTS[8]), (8, TEXTS[8])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.withColumn("n_words", F.lit("x")).withColumn("label", F.lit(1))
    labels = spark.createDataFrame([(8, 1), (5, 0), (0, 1), (None, 0)], "doc_id long, quality int")
    field = L.fit(docs, labels)
    found = L.line_verdicts(docs, field).collect()
    assert len(found) == len(rows)
    for row in found:
        text = TEXTS[8 if row.doc_id is None else row.doc_id]
        assert tuple(row)[1:7] == plain(text)
        assert not (row.base_failed and row.kept) and 0 <= row.content_share <= 1
    assert L.line_verdicts(docs.limit(0), L.fit(docs, labels.limit(0))).count() == 0


def test_rules_and_verdicts_on_documents(spark, mini):
    docs = spark.read.parquet(f"{mini}/documents.parquet")
    labels = spark.read.parquet(f"{mini}/labels.parquet")
    found = L.line_verdicts(docs, L.fit(docs, labels))
    rows = found.join(docs, "doc_id").join(labels, "doc_id", "left").collect()
    for row in rows[:400]:
        values = (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines)
        assert (*values, row.n_repeat_words, row.base_failed) == plain(row.text)
    good = [r for r in rows if r.quality == 1 and not r.base_failed]
    bad = [r for r in rows if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.99 * len(good)
    assert sum(r.kept for r in bad) <= 0.1 * len(bad)


def all_paths(emission, field):
    """Score of every label sequence of one text."""
    out = {}
    for path in itertools.product((0, 1), repeat=len(emission)):
        score = field.first[path[0]] + emission[0][path[0]]
        for t in range(1, len(path)):
            score += field.follows[path[t - 1], path[t]] + emission[t][path[t]]
        out[path] = score
    return out


@pytest.mark.parametrize("seed", range(5))
def test_viterbi_and_marginals_against_all_sequences(seed):
    rng = np.random.default_rng(seed)
    field = L.Field(rng.normal(size=(3, 2)), rng.normal(size=2), rng.normal(size=(2, 2)))
    sizes = rng.integers(0, 7, 9)
    ranges = np.concatenate([[0], np.cumsum(sizes)])
    emission = rng.normal(size=(ranges[-1], 2))
    labels = L.viterbi(emission, ranges, field)
    chance, pairs, total = L._marginals(emission, ranges, field)
    expected_pairs, expected_total = np.zeros((2, 2)), 0.0
    for a, b in zip(ranges[:-1], ranges[1:], strict=True):
        if a == b:
            continue
        paths = all_paths(emission[a:b], field)
        assert tuple(labels[a:b]) == max(paths, key=paths.get)
        z = math.log(sum(map(math.exp, paths.values())))
        expected_total += z
        for path, score in paths.items():
            p = math.exp(score - z)
            for t in range(1, len(path)):
                expected_pairs[path[t - 1], path[t]] += p
        for t in range(b - a):
            p = sum(math.exp(s - z) for path, s in paths.items() if path[t] == 1)
            assert math.isclose(chance[a + t, 1], p, abs_tol=1e-9)
    assert np.allclose(pairs, expected_pairs) and math.isclose(total, expected_total)


def test_training_learns_sticky_labels():
    rng = np.random.default_rng(1)
    labels = np.concatenate([[int(rng.integers(2))] * 8 for _ in range(80)])
    noisy = np.where(rng.random(len(labels)) < 0.25, 1 - labels, labels)
    x = np.stack([np.ones(len(labels)), noisy], axis=1)
    ranges = np.arange(0, len(labels) + 1, 8)
    field = L.train(x, labels, ranges, 200)
    found = L.viterbi(x @ field.weights, ranges, field)
    assert (found == labels).mean() > 0.9 > 0.8 > (noisy == labels).mean()
