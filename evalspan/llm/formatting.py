"""Duplicates hidden by formatting: one text but for white space, letter case, punctuation or field order.

A text is reduced to its letters and digits plus brackets, commas, colons and equals signs. Entries of a dict literal
and keyword arguments of a call are fields: each field's name and value are hashed, and the hashes of a literal's
fields are added up, which no order changes (a multiset hash, two sums of 64 bits). The sums stand in the text where
the fields stood; a 128-bit hash of that form is the fingerprint. Texts are grouped by it, and every member is then
compared with the group's first member field by field, as counted sets, without sorting.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import Workspace, skew_safe_join
from .components import connected_components

_PART = re.compile("([{}()\\[\\],:=\u0001])")
_OPEN = {"{": "}", "(": ")", "[": "]", "\u0001": ")"}
_MASK = (1 << 64) - 1


def reduced(source: Column) -> Column:
    """Letters and digits in lower case with the structural characters left; compound operators such as ``==`` and
    ``+=`` are dropped, and the bracket after ``def name`` is marked, since its defaults are no keyword arguments."""
    marked = F.regexp_replace(source, r"(?i)(\bdef\s+\w+\s*)\(", "$1\u0001")
    plain = F.regexp_replace(marked, r"[=!<>:+\-*/%&|^@]=+", "")
    return F.lower(F.regexp_replace(plain, "[^\\p{L}\\p{N}{}()\\[\\],:=\u0001]+", ""))


def stream(form: Column) -> Column:
    """The letters and digits of a reduced text alone."""
    return F.regexp_replace(form, "[{}()\\[\\],:=\u0001]+", "")


def _walk(form: str, pack, join):
    """The value of a reduced text: ``join`` makes a value of the parts of a sequence, ``pack`` one of several fields."""
    frames = [["", [], [], False]]  # opener, finished entries as (value, is field), parts of the entry at hand, field mark

    def end_entry(frame) -> None:
        frame[1].append((join(frame[2]), frame[3]))
        frame[2], frame[3] = [], False

    def close(frame):
        end_entry(frame)
        out, run = [], []
        for value, field in frame[1]:
            if field:
                run.append(value)
                continue
            out.extend([pack(run)] if len(run) > 1 else run)
            run = []
            out.append(value)
        out.extend([pack(run)] if len(run) > 1 else run)
        return join(out)

    def flat(frame):
        end_entry(frame)
        return join([v for v, _ in frame[1]])

    for part in _PART.split(form):
        if not part:
            continue
        top = frames[-1]
        if part in _OPEN:
            frames.append([part, [], [], False])
        elif part in "})]":
            if any(_OPEN.get(f[0]) == part for f in frames):
                while _OPEN.get(frames[-1][0]) != part:  # what stayed open inside is plain text
                    inner = frames.pop()
                    frames[-1][2].append(flat(inner))
                done = frames.pop()
                frames[-1][2].append(close(done))
        elif part == ",":
            end_entry(top)
        elif part == ":":
            top[3] = top[3] or top[0] == "{"
        elif part == "=":
            # a name alone before the sign makes a keyword argument
            top[3] = top[3] or (top[0] == "(" and len(top[2]) == 1)
        else:
            top[2].append(part)
    while len(frames) > 1:
        inner = frames.pop()
        frames[-1][2].append(flat(inner))
    return flat(frames[0])


def _sum_fields(fields: list[str]) -> str:
    one = two = 0
    for f in fields:
        h = xxhash.xxh3_128_intdigest(f)
        one, two = (one + (h & _MASK)) & _MASK, (two + (h >> 64)) & _MASK
    return f"\u0002{len(fields)}:{one:016x}{two:016x}\u0002"


def fingerprint(form: str) -> int:
    """128 bits that depend on the letters and digits in order, but not on the order of fields."""
    return xxhash.xxh3_128_intdigest(_walk(form, _sum_fields, "".join))


def _counted(parts: list) -> tuple:
    """A sequence of strings and counted sets, neighbouring strings joined."""
    out: list = []
    for p in parts:
        for x in p if isinstance(p, tuple) else (p,):
            if isinstance(x, str) and out and isinstance(out[-1], str):
                out[-1] += x
            elif x != "":
                out.append(x)
    return tuple(out)


def structure(form: str) -> tuple:
    """The text as a sequence of strings and counted sets of fields; equal for texts that differ in formatting alone."""
    return _walk(form, lambda fields: (frozenset(Counter(fields).items()),), _counted)


_FP = T.StructType([T.StructField("f1", T.LongType()), T.StructField("f2", T.LongType())])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


@F.pandas_udf(_FP)
def fingerprints(forms: pd.Series) -> pd.DataFrame:
    values = [fingerprint(f) for f in forms]
    return pd.DataFrame({"f1": [_signed(v & _MASK) for v in values], "f2": [_signed(v >> 64) for v in values]})


@F.pandas_udf(T.BooleanType())
def same_fields(one: pd.Series, two: pd.Series) -> pd.Series:
    """Whether two reduced texts hold the same letters, digits and fields."""
    cache: dict[str, tuple] = {}

    def of(form: str) -> tuple:
        if form not in cache:
            if len(cache) > 1000:
                cache.clear()
            cache[form] = structure(form)
        return cache[form]

    return pd.Series([a == b or of(a) == of(b) for a, b in zip(one, two)], dtype=bool)


def group_formatted(df: DataFrame, key: str, text: str, work: Workspace) -> DataFrame:
    """``key, group``: keys whose texts differ in formatting alone have the same group, the smallest of their keys.

    Equal keys are one record with all their texts. Rows with a null key or text are left out; empty texts (or texts
    of punctuation alone) are one group. Copies are merged before the texts are shuffled. Texts with equal letters
    and digits are one group even where only one of them shows its fields.
    """
    rows = df.where(F.col(key).isNotNull() & F.col(text).isNotNull())
    nodes = rows.select(F.col(key).alias("key"), reduced(F.col(text)).alias("form")).distinct()
    nodes = work.write(
        nodes.select("key", "form", F.xxhash64(stream(F.col("form"))).alias("s1"),
                     F.xxhash64(F.lit("2"), stream(F.col("form"))).alias("s2"), fingerprints("form").alias("f"))
        .select("key", "form", "s1", "s2", "f.f1", "f.f2"),
        "forms",
    )
    total = nodes.count()
    classes = None
    todo, rest = nodes, 0
    while True:
        leaders = work.write(todo.groupBy("f1", "f2").agg(F.min("key").alias("class"), F.count("*").alias("n")), f"leaders{rest}")
        many = leaders.where("n > 1")
        single = todo.join(leaders.where("n = 1").select("f1", "f2"), ["f1", "f2"], "left_semi")
        reps = (
            many.alias("l").join(todo.alias("t"), (F.col("l.f1") == F.col("t.f1")) & (F.col("l.f2") == F.col("t.f2")) & (F.col("l.class") == F.col("t.key")))
            .select("l.f1", "l.f2", "l.class", "l.n", F.col("t.form").alias("first"))
            .dropDuplicates(["f1", "f2"])
            .withColumn("fp", F.struct("f1", "f2")).drop("f1", "f2")
        )
        heavy = None
        if total > 100_000:
            heavy = reps.where(F.col("n") > max(100_000, total // 1000)).drop("n")
        checked = skew_safe_join(todo.withColumn("fp", F.struct("f1", "f2")), reps.drop("n"), "fp", heavy)
        checked = checked.withColumn("same", same_fields("form", "first")).select(
            "key", "s1", "s2", "f1", "f2", "class", "same", F.when(~F.col("same"), F.col("form")).alias("form")
        )
        checked = work.write(checked, f"checked{rest}")
        alone = single.select("key", "s1", "s2", F.col("key").alias("class"))
        good = checked.where("same").select("key", "s1", "s2", "class").unionByName(alone)
        classes = good if classes is None else classes.unionByName(good)
        todo = checked.where("not same").select("key", "form", "s1", "s2", "f1", "f2")
        if todo.isEmpty():  # else two different texts share 128 bits; what isn't the first goes round again
            break
        rest += 1
    # the same letters with and without visible fields, and keys with several texts, tie classes together
    by_stream = classes.groupBy("s1", "s2").agg(F.min("class").alias("a"), F.max("class").alias("b"))
    by_key = classes.groupBy("key").agg(F.min("class").alias("a"), F.max("class").alias("b"))
    ends = by_stream.where("a <> b").select("s1", "s2", "a")
    ties = (
        classes.join(ends, ["s1", "s2"]).where("class <> a").select("a", F.col("class").alias("b"))
        .unionByName(classes.join(by_key.where("a <> b").select("key", "a"), "key").where("class <> a").select("a", F.col("class").alias("b")))
    )
    merged = connected_components(ties, "a", "b", work, "classes")
    return (
        classes.join(merged, F.col("class") == F.col("node"), "left")
        .select("key", F.coalesce("component", "class").alias("group"))
        .distinct()
    )
