"""Counts against plain Python, gradients by what they achieve, scores by recomputation."""

import collections
import functools
import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paritas.llm import masked_lm as M
from paritas.llm import texts, word_counts


def words_of(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="module")
def network(docs):
    return M.fit(docs)


def hash_of(word):
    (piece,) = texts.slices(pa.array([word]))
    return int(M._words(piece)[0][0])


def test_vocabulary_and_triples_cover_all_documents(docs, network):
    count, values = collections.Counter(), [r.text for r in docs.collect()]
    for text in values:
        count.update(words_of(text))
    ranked = sorted(count.values(), reverse=True)
    by_hash = dict(zip(network.hashes.tolist(), network.tokens.tolist(), strict=True))
    for word, n in count.items():
        if n > ranked[M.FREQUENT]:
            assert hash_of(word) in by_hash
    expected = collections.Counter()
    for text in values:
        own = [by_hash.get(known(w)[0], M.FREQUENT + known(w)[1]) for w in words_of(text)]
        padded = [M.TOKENS - 1, *own, M.TOKENS - 1]
        for a, t, b in zip(padded, padded[1:], padded[2:]):
            expected[(a * M.TOKENS + b) * M.TOKENS + t] += 1
    found = M.triples(docs, network.hashes, network.tokens).collect()
    assert {r.key: r.n for r in found} == dict(expected)


@functools.cache
def known(word):
    (piece,) = texts.slices(pa.array([word]))
    h, shape, _ = M._words(piece)
    return int(h[0]), int(shape[0])


def tokens_of(text, network):
    by_hash = dict(zip(network.hashes.tolist(), network.tokens.tolist(), strict=True))
    words = words_of(text)
    return words, [by_hash.get(known(w)[0], M.FREQUENT + known(w)[1]) for w in words]


def counted(values, network):
    """Plain counts of words, neighbours, and neighbours with a class."""
    count = collections.Counter()
    for text in values:
        words, classes = tokens_of(text, network)
        line = [None, *words, None]
        for a, w, b, c in zip(line, words, line[2:], classes):
            count.update([("word", w), ("after", a, c), ("before", c, b), ("class", c)])
        if words:
            count.update(("pair", a, b) for a, b in zip(line, line[1:]))
    kinds = {k[1]: tokens_of(k[1], network)[1][0] for k in count if k[0] == "word"}
    count.update(("kinds", c) for c in kinds.values())
    return count


def expected_score(text, network, count, own):
    words, classes = tokens_of(text, network)
    line, end = [None, *words, None], M.TOKENS - 1
    around = [end, *classes, end]
    total = 0.0
    for i, (w, c) in enumerate(zip(words, classes, strict=True)):
        a, b = line[i], line[i + 2]
        hidden = np.tanh(network.before[around[i]] + network.after[around[i + 2]] + network.bias)
        total += float(M.log_softmax(hidden @ network.output.T + network.prior)[c])
        if c >= M.FREQUENT:
            inside = count["class", c] - own + count["kinds", c] + 1
            alone = (count["word", w] - own + 1) / inside
            k = word_counts.STRENGTH
            left = (count["pair", a, w] - own + k * alone) / (count["after", a, c] - own + k)
            right = (count["pair", w, b] - own + k * alone) / (count["before", c, b] - own + k)
            total += math.log((left + right) / 2)
    return total


def close(found, expected):
    return math.isclose(found, expected, rel_tol=2e-3, abs_tol=1e-2)


def test_scores_are_the_networks_and_the_corpus(docs, network):
    count = counted([r.text for r in docs.collect()], network)
    found = M.log_likelihoods(docs, network).collect()
    rows = {r.doc_id: r for r in found}
    assert len(found) == docs.count()
    right = 0
    some = docs.limit(60).collect()
    for row in some:
        one = rows[row.doc_id]
        assert one.n_tokens == len(words_of(row.text))
        if one.n_tokens:
            assert math.isclose(one.mean_log_likelihood * one.n_tokens, one.log_likelihood)
        right += close(one.log_likelihood, expected_score(row.text, network, count, 1))
    assert right == len(some)
    table = M.log_table(network)
    assert np.allclose(np.exp(table[:500]).sum(axis=1), 1.0, atol=1e-4)


def test_other_texts_are_scored_by_the_corpus(spark, docs, network):
    values = [r.text for r in docs.collect()]
    count = counted(values, network)
    new = [(1, "a wholly new zyxwv zyxwv text"), (2, values[3]), (3, None)]
    other = spark.createDataFrame(new, "doc_id long, text string")
    for row in M.log_likelihoods(other, network, docs).collect():
        text = dict(new)[row.doc_id]
        assert close(row.log_likelihood, expected_score(text, network, count, 0))


def test_words_of_a_class_share_its_probability(docs, network):
    """Over all words of a class, and one that is unknown, the second factor sums to 1."""
    values = [r.text for r in docs.collect()]
    count = counted(values, network)
    c = M.FREQUENT + int(network.class_words.argmax())
    kinds = [k[1] for k in count if k[0] == "word" and tokens_of(k[1], network)[1][0] == c]
    assert len(kinds) > 1000
    a = next(k[1] for k in count if k[0] == "after" and k[2] == c and k[1] is not None)
    b = next(k[2] for k in count if k[0] == "before" and k[1] == c and k[2] is not None)
    words = [*kinds, "unknown"]
    seen = word_counts.Seen(
        *(np.array(list(values), float) for values in (
            [count["word", w] for w in words],
            [count["pair", a, w] for w in words],
            [count["pair", w, b] for w in words],
            [count["after", a, c]] * len(words),
            [count["before", c, b]] * len(words),
        ))
    )
    sizes = network.class_tokens[c - M.FREQUENT], network.class_words[c - M.FREQUENT]
    assert sizes == (count["class", c], count["kinds", c])
    assert math.isclose(word_counts.within_class(seen, *sizes, 0).sum(), 1.0, rel_tol=1e-9)


def test_the_vocabulary_grows_with_the_corpus(docs, network):
    half = docs.filter("doc_id % 2 = 0")
    distinct = {w for r in docs.collect() for w in words_of(r.text)}
    assert network.vocabulary == len(distinct)
    assert M.fit(half).vocabulary < network.vocabulary


def test_texts_that_occur_twice_stand_apart(spark):
    import random

    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijklmnop", k=7)) for _ in range(4000)]
    rows = [(i, " ".join(rng.choices(words, k=80))) for i in range(300)]
    rows += [(300 + i, rows[i][1] + " more") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    mean = {r.doc_id: r.mean_log_likelihood for r in M.log_likelihoods(docs, M.fit(docs)).collect()}
    twice = [mean[i] for i in range(20)]
    assert min(twice) > max(mean[i] for i in range(20, 300))


def test_chunks_and_parts_do_not_change_the_scores(docs, network, monkeypatch):
    def scores(**more):
        found = M.log_likelihoods(docs, network, **more).collect()
        return {r.doc_id: r.log_likelihood for r in found}

    whole = scores()
    monkeypatch.setattr(word_counts, "PART_KEYS", 500)
    cut = scores(chunk_bytes=5000)
    assert whole.keys() == cut.keys()
    assert all(math.isclose(whole[i], cut[i], rel_tol=1e-6, abs_tol=1e-6) for i in whole)


def test_training_beats_the_prior_and_uses_both_sides(spark):
    import random

    rng = random.Random(1)
    rows = []
    for i in range(300):  # the middle word follows from both neighbours, from neither alone
        words = []
        for _ in range(60):
            a, b = rng.randrange(2), rng.randrange(2)
            words += [f"l{a}", f"m{a ^ b}", f"r{b}"]
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    network = M.fit(docs)
    good = spark.createDataFrame([(1, "l0 m1 r1 l1 m0 r1"), (2, "l0 m0 r1 l1 m1 r1")], docs.schema)
    one, two = M.log_likelihoods(good, network).orderBy("doc_id").collect()
    assert one.log_likelihood > two.log_likelihood + 4


def test_odd_rows(spark, network):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "w"), (None, "the of"), (4, "w"), (5, "x " * 50000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("n"))
    df = df.withColumn("part", F.lit(1)).withColumn("key", F.lit(2))
    found = M.log_likelihoods(df, network).collect()
    assert len(found) == len(rows)
    for row in found:
        blank = row.doc_id in (1, 2, 3)
        assert (row.n_tokens == 0) == blank == (row.mean_log_likelihood is None)
        assert (row.log_likelihood == 0) == blank
    assert M.log_likelihoods(df.limit(0), M.fit(df.limit(0))).count() == 0
    assert M.log_likelihoods(df, M.fit(df)).count() == len(rows)
