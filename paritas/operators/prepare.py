"""Cleaning the comment table and narrowing it to what evaluation needs."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paritas.catalogue import present_identities
from paritas.functions.values import binary_label, text_or_empty


def prepare_comments(
    df: DataFrame, threshold: float = 0.5, clean_text: bool = True
) -> DataFrame:
    """Binary label, texts without null, identity scores without null.

    Columns the table lacks are left out of the result. One projection, so only
    the columns named here are read from a columnar source.
    """
    text = text_or_empty(F.col("comment_text")) if clean_text else F.col("comment_text")
    columns = {
        "id": F.col("id"),
        "comment_text": text.alias("comment_text"),
        "target": F.col("target"),
        "is_toxic": binary_label(F.col("target"), threshold).alias("is_toxic"),
    }
    kept = [c for name, c in columns.items() if name in df.columns or name == "is_toxic"]
    return df.select(*kept, *[_filled(name) for name in present_identities(df.columns)])


# There are many identity columns, and a column built call by call costs the driver
# more than the query: so the rules of functions.values stand here as parsed text.


def _missing_as_zero(name: str) -> str:
    return f"coalesce(nanvl(CAST(`{name}` AS DOUBLE), 0D), 0D)"


def _filled(name: str) -> Column:
    return F.expr(f"{_missing_as_zero(name)} AS `{name}`")


def identity_scores(df: DataFrame, identities: Sequence[str] | None = None) -> DataFrame:
    """Wide identity columns to (id, ord, identity, score), missing scores as 0."""
    identities = identities or present_identities(df.columns)
    entries = ", ".join(
        f"struct({i} AS ord, '{name}' AS identity, {_missing_as_zero(name)} AS score)"
        for i, name in enumerate(identities)
    )
    return df.select("id", F.expr(f"inline(array({entries}))"))


def active_identities(identities: Sequence[str], membership_cut: float = 0.5) -> Column:
    """Positions of the identities a row belongs to, as array<int>.

    Most rows belong to few groups, so this is far smaller than the wide score
    columns and is what travels through the joins and shuffles of the metrics.
    """
    if not identities:
        return F.array().cast("array<int>")
    entries = ", ".join(
        f"IF({_missing_as_zero(name)} > {float(membership_cut)!r}D, {i}, NULL)"
        for i, name in enumerate(identities)
    )
    return F.expr(f"array_compact(array({entries}))")


def text_array(names: Sequence[str]) -> Column:
    """A constant array of strings, as one literal."""
    return F.from_json(F.lit(json.dumps(list(names))), "array<string>")


def subgroup_members(
    df: DataFrame, identities: Sequence[str] | None = None, membership_cut: float = 0.5
) -> DataFrame:
    """Long membership table (id, identity): only scores above the cut."""
    identities = identities or present_identities(df.columns)
    members = df.select("id", F.explode(active_identities(identities, membership_cut)).alias("i"))
    return members.select("id", F.get(text_array(identities), F.col("i")).alias("identity"))
