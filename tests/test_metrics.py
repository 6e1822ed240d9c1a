import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paritas.operators import metrics

KEYS = ["model"]


def scored(spark, rows):
    """rows: (label, score, groups)"""
    data = [("m", i, y, s, list(g)) for i, (y, s, g) in enumerate(rows)]
    return spark.createDataFrame(
        data, "model string, id bigint, is_toxic int, score double, groups array<int>"
    )


def brute_auc(rows):
    pos = [s for y, s in rows if y]
    neg = [s for y, s in rows if not y]
    if not pos or not neg:
        return None
    wins2 = sum(2 * (p > n) + (p == n) for p in pos for n in neg)
    return wins2 / (2 * len(pos) * len(neg))


def auc_of(spark, rows, ranges=None):
    df = metrics.group_auc(scored(spark, rows), KEYS, ranges=ranges)
    return {r[metrics.GROUP]: r["auc"] for r in df.collect()}


def table(spark, rows, names=("a", "b"), models=(("m",),), **options):
    df = metrics.bias_metrics(scored(spark, rows), list(models), names, KEYS, **options)
    return {r["identity"]: r for r in df.collect()}


@pytest.mark.parametrize(
    ("rows", "expected"),
    [
        ([(1, 0.9), (1, 0.8), (0, 0.1), (0, 0.2)], 1.0),
        ([(0, 0.9), (0, 0.8), (1, 0.1), (1, 0.2)], 0.0),
        ([(1, 0.5), (1, 0.5), (0, 0.5), (0, 0.5)], 0.5),
        ([(1, 0.5), (1, 0.8), (0, 0.5), (0, 0.2)], 0.875),
        ([(1, 0.5), (1, 0.8)], None),
        ([(0, 0.5)], None),
    ],
)
def test_auc_of_small_tables(spark, rows, expected):
    assert auc_of(spark, [(y, s, []) for y, s in rows])[None] == expected


def test_auc_equals_all_pairs_for_every_group_and_range_count(spark):
    rng = random.Random(3)
    rows = [
        (
            int(rng.random() < 0.3),
            rng.choice([rng.random(), rng.random() ** 9, 0.25, round(rng.random(), 1)]),
            [g for g in range(3) if rng.random() < 0.4],
        )
        for _ in range(700)
    ]
    expected = {None: brute_auc([(y, s) for y, s, _ in rows])}
    for g in range(3):
        expected[g] = brute_auc([(y, s) for y, s, groups in rows if g in groups])
    for ranges in (1, 4, 16, 256):
        assert auc_of(spark, rows, ranges) == expected


def test_score_of_a_third_of_all_rows_and_scores_in_a_corner(spark):
    rng = random.Random(5)
    rows = [(int(i % 3 == 0), 0.3, []) for i in range(400)]
    rows += [(int(rng.random() < 0.5), 1e-9 * rng.random(), []) for _ in range(400)]
    rows += [(int(rng.random() < 0.5), 1 - 1e-9 * rng.random(), []) for _ in range(400)]
    assert auc_of(spark, rows, 64)[None] == brute_auc([(y, s) for y, s, _ in rows])


def test_score_ranges_are_even_for_crowded_scores(spark):
    rows = [(i % 2, (i / 20_000) ** 8, []) for i in range(20_000)]
    df = scored(spark, rows)
    counts = metrics.score_counts(metrics.group_rows(df, KEYS), KEYS)
    sizes = [
        r["n"]
        for r in metrics.with_score_range(counts, df, 16)
        .groupBy("range")
        .agg(F.count("*").alias("n"))
        .collect()
    ]
    assert len(sizes) == 16
    assert max(sizes) <= 1.5 * 20_000 / 16


def test_score_ranges_are_even_for_unequal_partitions(spark):
    """Ten read partitions of ten rows each, and one of 100,000 with other scores."""
    few = spark.createDataFrame([(i / 1000, i % 2) for i in range(100)], "score double, y int")
    many = spark.range(0, 100_000, 1, 1).selectExpr("0.5 + id / 1e6 AS score", "int(id % 2) AS y")
    df = few.repartition(10).union(many).selectExpr(
        "'m' AS model", "y AS is_toxic", "score", "array(0) AS groups"
    )
    counts = metrics.score_counts(metrics.group_rows(df, KEYS), KEYS)
    sizes = metrics.with_score_range(counts, df, 16).groupBy("range").agg(
        F.sum(F.col("pos") + F.col("neg")).alias("n")
    )
    assert max(r["n"] for r in sizes.collect()) <= 1.5 * 2 * 100_100 / 16


@pytest.mark.parametrize("label", [None, 2, 0.7, -1])
def test_labels_other_than_0_and_1_fail(spark, label):
    df = spark.createDataFrame(
        [("m", 1, 1.0, 0.5, [0]), ("m", 2, None if label is None else float(label), 0.5, [0])],
        "model string, id bigint, is_toxic double, score double, groups array<int>",
    )
    for made in (metrics.bias_metrics(df, [("m",)], ["a"], KEYS), metrics.group_auc(df, KEYS)):
        with pytest.raises(Exception, match="neither 0 nor 1"):
            made.collect()


def test_partial_and_repeated_predictions_have_no_metrics(spark):
    labelled = spark.createDataFrame(
        [(i, i % 2, 1.0) for i in range(10)], "id bigint, is_toxic int, a double"
    )
    whole = [("m", i, i / 10) for i in range(10)]
    cases = {
        "whole": whole,
        "partial": whole[:4],
        "twice": whole + whole,
        "moved": [("m", max(i, 1), s) for _, i, s in whole],
        "beyond": [*whole, ("m", 99, 0.1)],
    }
    for name, rows in cases.items():
        predictions = spark.createDataFrame(rows, "model string, id bigint, score double")
        (row,) = metrics.evaluate_predictions(
            labelled, predictions, [("m",)], ["a"], KEYS
        ).collect()
        assert (row["subgroup_auc"] is not None) == (name in ("whole", "beyond")), name
        assert (row["overall_auc"] is not None) == (name in ("whole", "beyond")), name


@settings(
    max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(
    st.lists(
        st.tuples(
            st.integers(0, 1),
            st.one_of(st.floats(0, 1), st.sampled_from([0.0, 0.5, 1.0])),
            st.lists(st.integers(0, 1), unique=True),
        ),
        min_size=1,
        max_size=40,
    )
)
def test_auc_properties(spark, rows):
    # Eighths, so that one minus the score and its square keep order and ties.
    rows = [(y, round(s * 8) / 8, g) for y, s, g in rows]
    plain = auc_of(spark, rows)
    assert plain[None] == brute_auc([(y, s) for y, s, _ in rows])
    assert auc_of(spark, [(y, s * s, g) for y, s, g in rows]) == plain
    flipped = auc_of(spark, [(y, 1 - s, g) for y, s, g in rows])
    for group, value in plain.items():
        if value is None:
            assert flipped[group] is None
        else:
            assert flipped[group] == pytest.approx(1 - value)


def test_result_does_not_depend_on_partitions_or_order(spark):
    rows = [(i * 7 % 3 == 0, (i * 37 % 101) / 100, [i % 2]) for i in range(300)]
    df = scored(spark, [(int(y), s, g) for y, s, g in rows])
    results = [
        sorted(map(tuple, metrics.bias_metrics(d, [("m",)], ["a", "b"], KEYS).collect()))
        for d in (df, df.repartition(7), df.orderBy(F.desc("id")).coalesce(1))
    ]
    assert results[0] == results[1] == results[2]


def test_rates_are_undefined_when_one_class_is_missing(spark):
    got = table(spark, [(1, 0.9, [0]), (1, 0.1, [0]), (0, 0.2, [1]), (0, 0.7, [])])
    assert got["a"]["total_examples"] == 2
    assert got["a"]["subgroup_auc"] is None
    assert got["a"]["subgroup_fnr"] is None
    assert got["a"]["subgroup_fpr"] is None
    assert got["a"]["overall_fnr"] == 0.5
    assert got["b"]["overall_fpr"] == 0.5


def test_threshold_counts_from_the_boundary_on(spark):
    rows = [(1, 0.5, []), (1, 0.49, []), (0, 0.5, []), (0, 0.49, [])]
    got = table(spark, rows)["a"]
    assert (got["overall_fnr"], got["overall_fpr"]) == (0.5, 0.5)
    got = table(spark, rows, threshold=0.3)["a"]
    assert (got["overall_fnr"], got["overall_fpr"]) == (0.0, 1.0)


def test_no_predictions_still_give_a_row_per_model_and_identity(spark):
    df = metrics.bias_metrics(
        scored(spark, []), [("m",), ("n",)], ["a", "b"], KEYS
    ).collect()
    assert {(r["model"], r["identity"], r["total_examples"]) for r in df} == {
        (m, i, 0) for m in "mn" for i in "ab"
    }
    assert all(r["overall_auc"] is None and r["subgroup_fnr"] is None for r in df)


def test_unregistered_models_are_left_out(spark):
    got = table(spark, [(1, 0.9, [0])], models=[("other",)])
    assert got["a"]["total_examples"] == 0


@pytest.mark.parametrize("score", [math.nan, None])
def test_missing_scores_are_rejected(spark, score):
    df = metrics.bias_metrics(
        scored(spark, [(1, 0.9, []), (0, score, [])]), [("m",)], ["a"], KEYS
    )
    with pytest.raises(Exception, match="null or NaN"):
        df.collect()


def test_pair_counts_beyond_64_bits(spark):
    """10^10 positives and 9 * 10^10 negatives, as they arise from counts."""
    totals = spark.createDataFrame(
        [("m", None, 0, 0, 9 * 10**10, 0, 0), ("m", None, 1, 10**10, 0, 10**10, 0)],
        "model string, grp int, range int, pos bigint, neg bigint, tp bigint, fp bigint",
    ).withColumn("pairs2", F.lit(0).cast("decimal(38,0)"))
    row = metrics.group_totals(totals, KEYS).withColumn("auc", metrics.auc_column()).first()
    assert row["pairs2"] == 2 * 10**10 * 9 * 10**10
    assert row["auc"] == 1.0


def test_flat_metrics_omit_undefined_entries(spark):
    df = metrics.bias_metrics(
        scored(spark, [(1, 0.9, [0]), (0, 0.1, [0]), (1, 0.4, [1])]), [("m",)], ["a", "b"], KEYS
    )
    flat = {r["metric"]: r["value"] for r in metrics.flat_metrics(df, KEYS).collect()}
    assert flat == {
        "roc_auc": 1.0,
        "a_subgroup_auc": 1.0,
        "a_subgroup_fnr": 0.0,
        "a_subgroup_fpr": 0.0,
    }


def test_best_run_ignores_undefined_and_breaks_ties_by_name(spark):
    runs = spark.createDataFrame(
        [("c", 0.7), ("b", 0.9), ("a", 0.9), ("x", math.nan), ("y", None)],
        "model string, overall_auc double",
    )
    assert tuple(metrics.best_run(runs).first()) == ("a", 0.9)
    undefined = runs.where(F.col("model") == "x")
    assert tuple(metrics.best_run(undefined).first()) == (None, None)


def test_number_of_ranges_is_checked(spark):
    with pytest.raises(ValueError, match="power of four"):
        auc_of(spark, [(1, 0.5, [])], ranges=10)
    with pytest.raises(ValueError, match="no models"):
        table(spark, [(1, 0.5, [])], models=())


def marked_table(spark, ids, shown):
    """Metrics of one model whose scored rows have the ids ``shown``."""
    schema = "id long, is_toxic int, a double, b double"
    labelled = spark.createDataFrame([(i, i % 2, 0.9, 0.0) for i in ids], schema)
    predictions = spark.createDataFrame(
        [("d", "m", i, 0.1 + 0.8 * (i % 2)) for i in shown],
        "dataset string, model string, id long, score double",
    )
    rows = metrics.evaluate_predictions(labelled, predictions, [("d", "m")], ["a", "b"]).collect()
    return {r["identity"]: r for r in rows}


@pytest.mark.parametrize(
    ("shown", "complete"),
    [
        (range(8), True),
        ([*range(8), 99], True),
        (range(7), False),
        ([*range(7), 0], False),
        ([*range(6), 0, 1], False),
        ([0, 0, 0, *range(3, 8)], False),
        ([*range(8), *range(8)], False),
        ([], False),
    ],
)
def test_metrics_need_the_very_rows(spark, shown, complete):
    """Missing rows, rows twice and thrice, and both at once with the count unchanged."""
    got = marked_table(spark, range(8), shown)
    assert (got["a"]["overall_auc"] is not None) is complete
    assert got["b"]["total_examples"] == 0
    if complete:
        assert got["a"]["subgroup_auc"] == 1.0 and got["a"]["total_examples"] == 8


def test_repeated_labels_are_not_complete(spark):
    assert marked_table(spark, [0, 1, 2, 2], [0, 1, 2])["a"]["overall_auc"] is not None
    assert marked_table(spark, [0, 1, 2, 2], [0, 1])["a"]["overall_auc"] is None
