"""Ridge regression that leaves one group out, from sums alone.

Each group's moments (counts, sums and products of the features and the target) are added up in one aggregation. The
training moments of a fold are the total less the group's own, so no fold reads a row again, and a fold is a small
linear system whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Groups that may be folds: their moments, not their rows, are joined with the total.
ALPHA = 10.0


def leave_one_group_out(
    df: DataFrame, group: str, features: Sequence[str], target: str, alpha: float = ALPHA, source: Sequence[str] = ()
) -> DataFrame:
    """``group, intercept, coefficients`` of a ridge on standardised features (population deviation) per left-out group.

    Rows with a null feature or target are left out. A feature without deviation has coefficient 0. A fold whose
    training target is constant, or without training rows, is skipped. With ``source``, rows of other groups that share
    all these columns with a row of the left-out group aren't trained on either; a null there is no shared source.
    """
    d = len(features)
    rows = df.where(" and ".join(f"`{c}` is not null" for c in [*features, target, group]))
    x = [F.col(c).cast("double") for c in features] + [F.col(target).cast("double")]
    sums = [F.count("*").alias("n")] + [F.sum(c).alias(f"s{i}") for i, c in enumerate(x)]
    sums += [F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i in range(d + 1) for j in range(i, d + 1)]
    names = ["n", *[f"s{i}" for i in range(d + 1)], *[f"p{i}_{j}" for i in range(d + 1) for j in range(i, d + 1)]]
    if source:
        cells = rows.groupBy(group, *[F.col(c).alias(f"_source{i}") for i, c in enumerate(source)]).agg(*sums)
        keys = [f"_source{i}" for i in range(len(source))]
        known = " and ".join(f"{k} is not null" for k in keys)
        shared = cells.where(known).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in names])
        held = cells.where(known).select(group, *keys).join(shared, keys).select(group, *names)
        held = held.unionByName(cells.where(f"not ({known})").select(group, *names))
        per = held.groupBy(group).agg(*[F.sum(c).alias(c) for c in names])
        total = cells.agg(*[F.sum(c).alias(f"t_{c}") for c in names])
    else:
        per = rows.groupBy(group).agg(*sums)
        total = per.agg(*[F.sum(c).alias(f"t_{c}") for c in names])
    both = per.join(F.broadcast(total), F.lit(True))  # the total is one row
    schema = T.StructType([df.schema[group], T.StructField("intercept", T.DoubleType()), T.StructField("coefficients", T.ArrayType(T.DoubleType()))])

    def solve(frames):
        for f in frames:
            out = []
            for _, r in f.iterrows():
                n = r["t_n"] - r["n"]
                if n < 2:
                    continue
                s = np.array([r[f"t_s{i}"] - r[f"s{i}"] for i in range(d + 1)]) / n
                p = np.zeros((d + 1, d + 1))
                for i in range(d + 1):
                    for j in range(i, d + 1):
                        p[i, j] = p[j, i] = r[f"t_p{i}_{j}"] - r[f"p{i}_{j}"]
                cov = p - n * np.outer(s, s)
                if cov[d, d] <= 1e-12 * max(1.0, abs(p[d, d])):
                    continue
                dev = np.sqrt(np.maximum(np.diag(cov)[:d], 0) / n)
                keep = dev > 1e-12
                scale = np.where(keep, dev, 1.0)
                a = cov[:d, :d] / np.outer(scale, scale) + alpha * np.eye(d)
                w = np.where(keep, np.linalg.solve(a, cov[:d, d] / scale), 0.0) / scale
                out.append((r[group], float(s[d] - w @ s[:d]), [float(v) for v in w]))
            yield pd.DataFrame(out, columns=schema.names)

    return both.mapInPandas(solve, schema)


def held_out_predictions(df: DataFrame, folds: DataFrame, group: str, features: Sequence[str]) -> DataFrame:
    """``df`` with ``prediction`` of its own fold, the left-out group's; null for a skipped fold or a null feature."""
    f = folds.select(F.col(group).alias("_fold"), F.col("intercept").alias("_intercept"), F.col("coefficients").alias("_w"))
    value = F.col("_intercept")
    for i, c in enumerate(features):
        value = value + F.get("_w", F.lit(i)) * F.col(c)
    joined = df.join(f, F.col(group) == F.col("_fold"), "left")
    return joined.withColumn("prediction", value).drop("_fold", "_intercept", "_w")
