"""Greedy string tiling against a plain version that compares all words."""

import random
import re

from pyspark.sql import functions as F

from paritas.llm import tiling


def words_of(text):
    text = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", text)


def naive_covered(item, text, minimum=5):
    """Words covered by marking the longest common free run until none is left."""
    free_i, free_t, total = [True] * len(item), [True] * len(text), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                n = 0
                while (
                    i + n < len(item)
                    and j + n < len(text)
                    and free_i[i + n]
                    and free_t[j + n]
                    and item[i + n] == text[j + n]
                ):
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < minimum:
            return total
        free_i[i : i + n] = [False] * n
        free_t[j : j + n] = [False] * n
        total += n


def test_tiles_against_plain_version():
    rng = random.Random(3)
    for _ in range(150):
        letters = rng.choice([3, 6, 40])
        item = [rng.randrange(1, letters) for _ in range(rng.randrange(1, 40))]
        text = [rng.randrange(1, letters) for _ in range(rng.randrange(0, 30))]
        cut = rng.randrange(len(item))
        text += item[cut:] + item[:cut]
        found = tiling.tiles(item, text, list(range(len(text))), 3)
        assert sum(n for _, _, n in found) == naive_covered(item, text, 3)
        for i, j, n in found:
            assert item[i : i + n] == text[j : j + n]


def test_a_gap_ends_a_match():
    assert tiling.tiles([1, 2, 3, 4], [1, 2, 3, 4], [0, 1, 5, 6], 3) == []


def test_against_brute_force(spark, mini):
    docs = spark.read.parquet(f"{mini}/documents.parquet")
    items = spark.read.parquet(f"{mini}/benchmark.parquet")
    runs = {}
    listed = [(r.item_id, words_of(r.text)) for r in items.collect()]
    for item_id, item in listed:
        for i in range(len(item) - 4):
            runs.setdefault(tuple(item[i : i + 5]), set()).add(item_id)
    expected = set()
    for row in docs.collect():
        text = words_of(row.text)
        met = set()
        for j in range(len(text) - 4):
            met |= runs.get(tuple(text[j : j + 5]), set())
        for item_id, item in listed:
            if item_id in met and naive_covered(item, text) >= 0.5 * len(item):
                expected.add((row.doc_id, item_id))
    found = tiling.contaminated(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in found} == expected and len(found) == len(expected)
    assert len(expected) > 10


def test_reordered_passage_and_odd_rows(spark):
    rng = random.Random(5)
    item = [f"w{rng.randrange(1000)}" for _ in range(30)]
    reordered = " x ".join(" ".join(item[i : i + 6]) for i in (24, 6, 18, 0, 12)).upper()
    scattered = " x ".join(" ".join(item[i : i + 4]) for i in range(0, 28, 4))
    rows = [
        (1, "so " + reordered + "."),
        (2, scattered),
        (3, ""),
        (4, None),
        (None, " ".join(item)),
        (5, " ".join(item)),
        (5, " ".join(item)),
        (6, "clean text of a few words"),
        (7, "w " * 5000),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.withColumn("print", F.lit("p")).withColumn("words", F.lit(1))
    bench = [(9, ", ".join(item)), (9, ", ".join(item)), (8, "w0 w1"), (None, None), (7, "")]
    items = spark.createDataFrame(bench, "item_id long, text string").withColumn("at", F.lit(0))
    found = tiling.contaminated(docs, items)
    assert sorted((r.doc_id or 0, r.item_id) for r in found.collect()) == [(0, 9), (1, 9), (5, 9)]
    kept = tiling.keep_clean(docs, items)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 6, 7]
    assert kept.columns == docs.columns
    none = docs.limit(0)
    assert tiling.contaminated(none, items).count() == 0
    assert tiling.contaminated(docs, items.limit(0)).count() == 0
    assert tiling.keep_clean(docs, items.limit(0)).count() == len(rows)
