"""Distinct members per group, in long form.

A group's users, tables or prefixes are rows, never one array: each input row
becomes a total row plus one row per member, which combine before the shuffle
on (group, kind, member). One pass serves any number of distinct counts, and a
group that holds a third of all rows is spread over its members.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import partial

from pyspark.sql import Column, DataFrame, functions as F, types as T


def member_rows(
    df: DataFrame,
    keys: Sequence[str],
    members: Mapping[str, str],
    measures: Sequence[str] = (),
) -> DataFrame:
    """(keys, kind, member, measures): the distinct members and, under the
    empty kind, the sums. ``members`` maps a kind to its column, which may be
    an array."""

    def item(kind: str, member: Column, carry: bool) -> Column:
        sums = [
            (F.col(m) if carry else F.lit(None)).cast("bigint").alias(m) for m in measures
        ]
        return F.struct(F.lit(kind).alias("kind"), member.alias("member"), *sums)

    parts = [F.array(item("", F.lit("").cast("string"), True))]
    for kind, column in members.items():
        if isinstance(df.schema[column].dataType, T.ArrayType):
            parts.append(F.transform(column, partial(_member, item, kind)))
        else:
            parts.append(F.array(item(kind, F.col(column), False)))
    parts = [F.coalesce(p, F.array().cast(f"array<{_item_type(measures)}>")) for p in parts]
    exploded = df.select(*keys, F.explode(F.concat(*parts)).alias("_m")).select(*keys, "_m.*")
    rows = exploded.filter(F.col("member").isNotNull())
    if not measures:
        return rows.distinct()
    return rows.groupBy(*keys, "kind", "member").agg(*(F.sum(m).alias(m) for m in measures))


def _member(item: Callable[[str, Column, bool], Column], kind: str, element: Column) -> Column:
    return item(kind, element, False)


def _item_type(measures: Sequence[str]) -> str:
    fields = ["kind: string", "member: string", *(f"{m}: bigint" for m in measures)]
    return f"struct<{', '.join(fields)}>"


def count_members(
    rows: DataFrame,
    keys: Sequence[str],
    counts: Mapping[str, str],
    measures: Sequence[str] = (),
) -> DataFrame:
    """Fold member rows to one row per group: ``counts`` maps kind to column name."""
    return rows.groupBy(*keys).agg(
        *(F.sum(m).alias(m) for m in measures),
        *(F.count_if(F.col("kind") == kind).alias(name) for kind, name in counts.items()),
    )


def distinct_members(df: DataFrame, keys: Sequence[str], members: Mapping[str, str]) -> DataFrame:
    """The set union of members per group as rows (keys, kind, member)."""
    rows = member_rows(df, keys, members)
    return rows.filter(F.col("kind") != "").select(*keys, "kind", "member")
