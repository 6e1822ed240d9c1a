"""Viterbi against a plain version, and exact round trips."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paritas.llm import pieces as P
from paritas.llm import texts

ODD = [
    "  Hello  wörld\n\nx",
    "",
    " ",
    "a" * 3000,
    "日本 ☃ 🙂🙂",
    "\x00\x7f \t",
    "x" * 20000 + " end",
    "The quick brown fox.",
    "é ñ",
]


@pytest.fixture(scope="module")
def model():
    return P.load()


def plain_score(text, words):
    """The best sum of scores over all sequences of pieces of a spaced text."""
    score = {words.content[i]: s for i, s in zip(words.ids, words.scores, strict=True)}
    text = (" " + text if words.prefix and text else text).encode()
    begins = [i for i in range(len(text) + 1) if i == len(text) or text[i] & 0xC0 != 0x80]
    best, last = {0: 0.0}, 0
    for end in begins[1:]:
        best[end] = best[last] + words.unknown
        for start in begins:
            if start < end <= start + words.longest and text[start:end] in score:
                best[end] = max(best[end], best[start] + score[text[start:end]])
        last = end
    return best[len(text)]


def score_of(ids, words):
    by_id = dict(zip(words.ids.tolist(), words.scores.tolist(), strict=True))
    raw, total = bytearray(), 0.0
    for i in ids:
        if i in by_id:
            total += by_id[i]
        else:
            raw += words.content[i]
    return total + words.unknown * len(raw.decode())


def encoded(values, words, limit=1 << 20):
    out = []
    for piece in texts.slices(pa.array(values), limit):
        ids, ranges = P.encoded(piece, words)
        out += [ids[a:b].tolist() for a, b in zip(ranges[:-1], ranges[1:], strict=True)]
        data, at = P.decoded(ids, ranges, words)
        back = [bytes(data[a:b]).decode() for a, b in zip(at[:-1], at[1:], strict=True)]
        assert back == values[piece.first : piece.first + piece.rows]
    return out


def test_best_sequences_of_the_model(model):
    rng = random.Random(2)
    values = [t for t in ODD if len(t) < 100]
    values += ["".join(rng.choice("abcé 日t") for _ in range(rng.randrange(30))) for _ in range(60)]
    for value, ids in zip(values, encoded(values, model), strict=True):
        assert score_of(ids, model) == pytest.approx(plain_score(value, model))


def test_best_sequences_of_random_vocabularies():
    rng = random.Random(4)
    for _ in range(20):
        made = {"".join(rng.choice("ab▁é") for _ in range(rng.randrange(1, 5))) for _ in range(25)}
        made = sorted(p for p in made if "▁" not in p.lstrip("▁"))
        names = [f"<{b}>" for b in range(256)] + made
        scores = [0.0] * 256 + [-rng.random() * 9 for _ in made]
        words = P.vocabulary(names, scores, list(range(256)), set(), rng.random() < 0.5)
        values = ["".join(rng.choice("ab é☃") for _ in range(rng.randrange(14))) for _ in range(40)]
        for value, ids in zip(values, encoded(values, words, 30), strict=True):
            assert score_of(ids, words) == pytest.approx(plain_score(value, words))


def test_a_piece_that_spans_words_is_refused():
    with pytest.raises(ValueError, match="spans"):
        P.vocabulary([*map(str, range(256)), "a▁b"], [0.0] * 257, list(range(256)), set(), True)


def test_known_pieces(model):
    (ids,) = encoded(["the of and"], model)
    assert [model.content[i] for i in ids] == [b" the", b" of", b" and"]


def test_columns_with_nulls_and_repeats(spark, model):
    values = [*ODD, None, None, *ODD, "with ▁ in it"]
    df = spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")
    df = df.withColumn("n_pieces", F.lit("x")).withColumn("ids", F.lit(1))
    spelt = P.with_text(P.with_pieces(df, model), model, name="again").orderBy("doc_id").collect()
    assert [r.again for r in spelt] == [*values[:-1], "with   in it"]
    assert [r.pieces is None for r in spelt] == [v is None for v in values]
    rows = P.round_trip(df, model).collect()
    assert all(r.round_trip for r in rows) and len(rows) == len(values)
    assert all(len(r.pieces or []) == r.n_pieces for r in rows)
    made = P.with_text(P.with_pieces(df, model), model, name="back").select("pieces", "back")
    expected = sorted((r.pieces for r in made.collect()), key=repr)
    assert sorted((r.pieces for r in rows), key=repr) == expected
    assert P.round_trip(df.limit(0), model).count() == 0


def test_whole_table(spark, mini, model):
    docs = spark.read.parquet(f"{mini}/documents.parquet")
    rows = P.round_trip(docs, model).collect()
    assert len(rows) == docs.count() and all(r.round_trip for r in rows)
    assert sum(r.n_pieces for r in rows) < sum(r.n_bytes for r in rows)
    assert np.median([r.n_pieces for r in rows]) > 100
