"""Splits that keep related records together.

Every record names entities (here the repository in ``instance_id`` and the one in ``image_name``). Records sharing an
entity, directly or through others, are one group: the connected components of the entities, found by alternating
large-star and small-star. A hash of the component picks the split from consecutive ranges of the given proportions,
so equal groups get equal splits on every run and new groups don't move old ones.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import seed_of, seeded_digest
from ..runtime import Workspace, skew_safe_join
from .components import connected_components

#: Owner, repository and commit as written in either column; ``__`` or ``_1776_`` parts owner and repository.
REPOSITORY = r"(?:^|[./\s])([A-Za-z0-9_-]+?)(?:__|_1776_)([A-Za-z0-9_-]+)\.[0-9A-Fa-f]{7,40}(?![0-9A-Za-z])"
PROPORTIONS = {"train": 0.8, "validation": 0.1, "test": 0.1}
SEED = "splits-1"


def repository(value: Column) -> Column:
    """``owner/name`` in lower case with hyphens for underscores; null where the text names no repository."""

    def part(n: int) -> Column:
        return F.translate(F.lower(F.regexp_extract(value, REPOSITORY, n)), "_", "-")

    return F.when(part(1) != "", F.concat(part(1), F.lit("/"), part(2)))


#: Rows from which an entity or a group may count as heavy; below this any task can hold them.
HEAVY_FLOOR = 100_000


def group_records(df: DataFrame, row_key: str, entities: Sequence[Column], work: Workspace, heavy_floor: int = HEAVY_FLOOR) -> DataFrame:
    """``df`` with ``group_id`` (which replaces a column of that name): rows that share an entity, directly or through other rows, have the same.

    A record's first entity that isn't null stands for it; the others tie that entity to further ones, so only records
    with two different entities become links. Records without any entity are groups of their own, named by their key.
    Null keys are allowed; a record without key and entity has the group ``row:``.
    """
    # the caller's columns travel in a struct, so that none can clash with those here
    named = df.select(F.struct("*").alias("_row"), F.coalesce(*entities).alias("_entity"))
    ties = None
    for entity in entities[1:]:
        tie = df.select(F.coalesce(*entities).alias("a"), entity.alias("b")).where("a <> b").distinct()
        ties = tie if ties is None else ties.unionByName(tie)
    if ties is not None:
        groups = connected_components(ties, "a", "b", work, "groups")
        stats = named.groupBy("_entity").agg(F.count("*").alias("n"))
        stats = stats.join(groups.withColumnRenamed("node", "_entity"), "_entity")
        # entities with more than a ten-thousandth of the rows are at most ten thousand: they may be broadcast
        stats = work.write(stats, "entities")
        floor = max(heavy_floor, (stats.agg(F.sum("n")).first()[0] or 0) // 10_000)
        heavy = stats.where(F.col("n") > floor).select("_entity", F.col("component").alias("hot"))
        rest = stats.where(F.col("n") <= floor).select("_entity", "component")
        # rows of a heavy entity, and rows without one, stay where they are
        marked = named.where("_entity is not null").join(F.broadcast(heavy), "_entity", "left")
        hot = marked.where("hot is not null").select("_row", F.col("hot").alias("_group"))
        others = marked.where("hot is null").drop("hot").join(rest, "_entity", "left").select("_row", F.coalesce("component", "_entity").alias("_group"))
        none = named.where("_entity is null").select("_row", F.col("_entity").alias("_group"))
        named = hot.unionByName(others).unionByName(none)
    else:
        named = named.select("_row", F.col("_entity").alias("_group"))
    own = F.concat(F.lit("row:"), F.coalesce(F.col(f"_row.{row_key}").cast("string"), F.lit("")))
    kept = [F.col(f"_row.`{c}`") for c in df.columns if c != "group_id"]
    return named.select(*kept, F.coalesce("_group", own).alias("group_id"))


def assign_split(group: Column, proportions: Mapping[str, float] = PROPORTIONS, seed: str = SEED) -> Column:
    """The split whose range of the unit interval holds the group's hash; the proportions must add up to 1."""
    if abs(sum(proportions.values()) - 1) > 1e-9 or min(proportions.values()) < 0:
        raise ValueError("the proportions must be at least 0 and add up to 1")
    u = seed_of(seeded_digest(seed, group)) / float(1 << 32)
    out, edge = F.lit(list(proportions)[-1]), 0.0
    conditions = []
    for name, share in proportions.items():
        edge += share
        conditions.append((u < edge, name))
    for condition, name in reversed(conditions[:-1]):
        out = F.when(condition, name).otherwise(out)
    return out


def normal_split(value: Column) -> Column:
    """``train`` or ``heldout`` whatever the spelling; null for null and for anything else."""
    letters = F.regexp_replace(F.lower(value), "[^a-z]", "")
    return F.when(letters.isin("train", "heldout"), letters)


def broken_groups(grouped: DataFrame, split: str, total: int, heavy_floor: int = HEAVY_FLOOR) -> DataFrame:
    """Rows with a split that isn't null in a group that holds both frozen splits."""
    rows = grouped.where(F.col(split).isNotNull()).select(F.struct("*").alias("_row"), "group_id", normal_split(F.col(split)).alias("s"))
    both = (
        rows.groupBy("group_id").agg(F.min("s").alias("a"), F.max("s").alias("b"), F.count("*").alias("n")).where("a <> b").select("group_id", "n")
    )
    # at most a thousand groups hold more than a thousandth of the rows
    heavy = both.where(F.col("n") > max(heavy_floor, total // 1000)).drop("n") if total > heavy_floor else None
    return skew_safe_join(rows.drop("s"), both.drop("n"), "group_id", heavy).select("_row.*")
