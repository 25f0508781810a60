"""Bounded training samples, the same at every size of input."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bounded_sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """The distinct ``rows`` (narrow ones) of the ``most`` values of ``key`` that have the smallest hashes."""
    distinct = rows.dropDuplicates()
    hashed = F.xxhash64(F.col(key), F.lit("sample"))
    last = distinct.select(hashed.alias("h")).distinct().orderBy("h").limit(most).agg(F.max("h")).first()[0]
    return distinct.where(hashed <= last) if last is not None else distinct.limit(0)


def sample_per_group(rows: DataFrame, group: str, by: list[str], most: int, most_groups: int) -> DataFrame:
    """Of each of the ``most_groups`` largest groups as many rows as ``most`` allows each, those of the smallest hashes of ``by``.

    Groups that have fewer leave their share unused.  Rows equal in ``by`` come along together.  Hashes are spread evenly, so a
    group's size tells below which its share lies, with some to spare; only those few hashes are sorted.
    """
    hashed = F.xxhash64(*by, F.lit("sample"))
    groups = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.min(hashed).alias("least")).orderBy(F.desc("n"), group).limit(most_groups).collect()
    if not groups:
        return rows.limit(0)
    each = max(most // len(groups), 1)

    def below(bounds: dict[object, int]) -> DataFrame:
        table = F.create_map(*(F.lit(x) for pair in bounds.items() for x in pair))
        return rows.where(F.col(group).isin(list(bounds))).where(hashed <= table[F.col(group)])

    spare = each + 6 * each**0.5 + 10
    near = below({g: max(least, -(2**63) + int(min(spare / n, 1) * (2**64 - 1))) for g, n, least in groups})
    nth = F.row_number().over(Window.partitionBy(group).orderBy("h"))
    first = near.select(group, hashed.alias("h")).withColumn("nth", nth).where(F.col("nth") <= each)
    return below(dict(first.groupBy(group).agg(F.max("h")).collect()))
