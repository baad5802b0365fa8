"""Mixing sources to target weights along a curriculum.

Each source has a weight schedule over the training run: weights at points of time from 0 to 1, linear between them. By
default it is a ramp, ``1 + ramp * (2 t - 1)``, up for sources that are repeated and down for the others. The integral
of a schedule is the source's token demand up to a time; inverting it, piece by piece, at a text's cumulative tokens
gives the time at which the text is due, and the texts are range-sorted by it. Cumulative tokens come from sums per
bucket of texts, so that a source of any size is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import Workspace

#: Texts in a bucket, about; bounds what one task sorts.
BUCKET_TEXTS = 50_000
#: Sources in a mix; their totals (not their texts) are planned on the driver.
MOST_SOURCES = 100_000
RAMP = 0.5
SEED = "mix-1"


def source_name(value: Column) -> Column:
    """A source's name whatever the letter case, hyphens for underscores and outer blanks."""
    return F.regexp_replace(F.lower(F.trim(value)), r"[-\s]+", "_")


#: Times from 0 to 1 and the weights there.
Schedule = Sequence[tuple[float, float]]


@dataclass(frozen=True)
class Plan:
    source: str
    target_share: float | None
    max_repeats: int
    texts: int
    tokens: int
    wanted: float
    schedule: Schedule


def normal_schedule(points: Schedule) -> Schedule:
    """The points in order of time, from 0 to 1 (the outer weights hold beyond the outer points), with an integral of 1.

    Raises for a time outside 0 to 1, a time given twice, a negative weight, and weights that are all zero.
    """
    points = sorted((float(t), float(w)) for t, w in points)
    times = [t for t, _ in points]
    if not points or times[0] < 0 or times[-1] > 1 or len(set(times)) < len(times) or min(w for _, w in points) < 0:
        raise ValueError(f"not a schedule: {points}")
    points = [(0.0, points[0][1])] * (times[0] > 0) + points + [(1.0, points[-1][1])] * (times[-1] < 1)
    area = sum((t - s) * (v + w) / 2 for (s, v), (t, w) in zip(points, points[1:]))
    if area <= 0:
        raise ValueError("a schedule needs a weight above zero")
    return [(t, w / area) for t, w in points]


def plan_mix(sources: list[dict], size: int | None = None, schedules: Mapping[str, Schedule] | None = None) -> list[Plan]:
    """Token demand and schedule of each source; ``schedules`` has those that aren't to follow the ramp.

    The mix has ``size`` tokens, by default as many as its sources hold, or fewer if the repeats don't allow it. A
    source gets its share of that, or all that its repeats allow; what it can't fill goes to the others in proportion
    to their shares. Sources with a null or zero share, or without texts, get nothing.
    """
    share = {s["source"]: max(s["target_share"] or 0.0, 0.0) for s in sources}
    cap = {s["source"]: (s["tokens"] or 0) * max(s["max_repeats"] or 0, 0) for s in sources}
    able = sorted((s for s in share if share[s] > 0 and cap[s] > 0), key=lambda s: (cap[s] / share[s], s))
    left = float(min(size if size is not None else sum(s["tokens"] or 0 for s in sources if s["source"] in able), sum(cap[s] for s in able)))
    weight, wanted = sum(share[s] for s in able), dict.fromkeys(share, 0.0)
    for s in able:
        wanted[s] = min(float(cap[s]), left * share[s] / weight)
        left, weight = left - wanted[s], weight - share[s]
        if weight <= 0:
            break
    total = sum(wanted.values()) or 1.0
    # texts that are used more than once come late; the ramps are shifted so that the rates add up to 1 at any time
    raw = {s["source"]: RAMP if wanted[s["source"]] > (s["tokens"] or 0) else -RAMP for s in sources}
    mean = sum(raw[s] * wanted[s] for s in wanted) / total
    widest = max([1.0, *(abs(raw[s] - mean) for s in wanted)])
    given = {} if schedules is None else schedules
    ramp = {s: (raw[s] - mean) / widest for s in wanted}
    return [
        Plan(s["source"], s["target_share"], s["max_repeats"] or 0, s["texts"] or 0, s["tokens"] or 0, wanted[s["source"]],
             normal_schedule(given.get(s["source"], [(0, 1 - ramp[s["source"]]), (1, 1 + ramp[s["source"]])])))
        for s in sources
    ]


def due_time(done: Column, times: Column, weights: Column) -> Column:
    """The time at which the integral of a normal schedule reaches ``done`` (from 0 to 1), the earliest where that holds
    for a stretch: the piece is found among the integrals up to the points, and a quadratic equation gives the rest."""
    steps = F.sequence(F.lit(1), F.size(times) - 1)
    area = F.transform(steps, lambda i: (F.get(times, i) - F.get(times, i - 1)) * (F.get(weights, i) + F.get(weights, i - 1)) / 2)
    sums = F.transform(steps, lambda i: F.aggregate(F.slice(area, F.lit(1), i), F.lit(0.0), lambda x, y: x + y))
    k = F.least(F.size(F.filter(sums, lambda x: x < done)), F.size(times) - 2)
    left = done - F.when(k > 0, F.get(sums, k - 1)).otherwise(0.0)
    t, w, width = F.get(times, k), F.get(weights, k), F.get(times, k + 1) - F.get(times, k)
    slope = (F.get(weights, k + 1) - w) / width
    # the stable form of the root, also right for a slope of 0
    root = F.sqrt(F.greatest(w * w + 2 * slope * left, F.lit(0.0)))
    return F.when(left <= 0, t).otherwise(t + F.least(width, F.coalesce(F.try_divide(2 * left, w + root), F.lit(0.0))))


def mix(
    texts: DataFrame, targets: DataFrame, work: Workspace, size: int | None = None, schedules: Mapping[str, Schedule] | None = None
) -> tuple[DataFrame, list[Plan]]:
    """``texts`` has ``doc_id, source, tokens, h1, h2`` (a text's hash); ``targets`` has ``source, target_share, max_repeats``.

    Returns one row per use of a text: ``position`` (in tokens of the mix), ``doc_id``, ``copy``, ``source``, ``tokens``,
    sorted by position, and the plan. Equal texts count as one, at their smallest doc_id. Texts of sources without a
    target, and texts without tokens, aren't used; doubled targets count once (the largest share). ``schedules`` gives
    weights over time by a source's name (see ``source_name``), in place of the ramp.
    """
    named = targets.where("source is not null").groupBy(source_name(F.col("source")).alias("source")).agg(
        F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    if named.limit(MOST_SOURCES + 1).count() > MOST_SOURCES:
        raise ValueError(f"a mix has {MOST_SOURCES} sources at most")
    # one row per source: bounded by the check above
    wanted = named.where("target_share > 0").select("source")
    once = texts.where("tokens > 0").join(F.broadcast(wanted), "source", "left_semi")
    once = once.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "source", "tokens")).alias("t")).select("t.*")
    once = work.write(once, "once")
    sums = once.groupBy("source").agg(F.count("*").alias("texts"), F.sum("tokens").alias("tokens"))
    plan = plan_mix([r.asDict() for r in named.join(sums, "source", "left").orderBy("source").collect()], size, schedules)
    plans = work.spark.createDataFrame(
        [(p.source, p.tokens, p.wanted, [t for t, _ in p.schedule], [w for _, w in p.schedule]) for p in plan if p.wanted > 0],
        "source string, all_tokens long, wanted double, times array<double>, weights array<double>",
    )
    buckets = max(1, once.count() // BUCKET_TEXTS)
    order = F.xxhash64(F.lit(SEED), F.col("doc_id"))
    rows = once.withColumn("o", order).withColumn("b", F.floor((F.col("o") / 2.0**64 + 0.5) * buckets).cast("long"))
    before = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("source", "b").agg(F.sum("tokens").alias("n")).select(
        "source", "b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "b").orderBy("o", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(offsets, ["source", "b"])
    total = sum(p.wanted for p in plan)
    uses = (
        rows.join(F.broadcast(plans), "source")
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.floor(F.col("wanted") / F.col("all_tokens")).cast("int"))))
        .withColumn("start", F.col("copy") * F.col("all_tokens") + F.col("offset") + F.col("within"))
        .where("start + tokens / 2.0 <= wanted")  # the nearest end to the demand
        .withColumn("position", due_time(F.col("start") / F.col("wanted"), F.col("times"), F.col("weights")) * total)
        .select("position", "doc_id", "copy", "source", "tokens")
    )
    return uses, plan


def shares(uses: DataFrame, plan: list[Plan]) -> DataFrame:
    """Per source of the plan the share reached beside the target: one row per source."""
    spark = uses.sparkSession
    base = spark.createDataFrame(
        [(p.source, p.target_share, p.max_repeats, p.texts, p.tokens) for p in plan],
        "source string, target_share double, max_repeats int, texts long, tokens long",
    )
    used = uses.groupBy("source").agg(F.sum("tokens").alias("used"), F.count("*").alias("uses"), (F.max("copy") + 1).alias("most_repeats"))
    all_ = Window.partitionBy(F.lit(1))  # one row per source
    return base.join(used, "source", "left").select(
        "source", "target_share", "max_repeats", "texts", "tokens",
        F.coalesce("used", F.lit(0)).alias("used_tokens"), F.coalesce("uses", F.lit(0)).alias("uses"),
        F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
        F.try_divide(F.coalesce("used", F.lit(0)).cast("double"), F.sum("used").over(all_)).alias("actual_share"),
    )
