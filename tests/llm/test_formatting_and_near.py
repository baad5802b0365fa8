import random
import re

import pytest
from pyspark.sql import functions as F

from evalspan.llm import formatting, near

A = 'def f(a, b=1):\n    x = {"k": 1, "j": g(u=2, v="w")}\n    return call(x, b=b, c=3)'
SAME = [
    A.upper(), A.replace("\n    ", " ; "), A.replace('"k": 1, "j": g(u=2, v="w")', "'j':g(v='w',u=2),'k':1"), A.replace("b=b, c=3", "c = 3, b = b"),
    A.replace("{", "").replace("}", ""),
]
OTHER = [A.replace("x, b=b", "b=b, x"), A.replace("1", "2"), A.replace("return", "yield"), 'def f(b=1, a=2): pass', "def f(a=2, b=1): pass"]


def groups(spark, work, rows):
    df = spark.createDataFrame(rows, "sha string, source string")
    for name in ("group", "form", "key", "f1", "class"):
        df = df.withColumn(name, F.lit(1))
    return {r["key"]: r["group"] for r in formatting.group_formatted(df, "sha", "source", work).collect()}


def test_formatting_groups(spark, work):
    rows = [("a", A)] + [(f"b{i}", s) for i, s in enumerate(SAME)] + [(f"c{i}", s) for i, s in enumerate(OTHER)]
    rows += [("a", A)] * 3 + [(None, A), ("n", None), ("e", ""), ("e2", " ;; "), ("long", "x" * 200_000), ("long2", "X " * 200_000)]
    got = groups(spark, work, rows)
    assert {got[f"b{i}"] for i in range(len(SAME))} == {"a"} == {got["a"]}
    assert [got[f"c{i}"] for i in range(3)] == ["c0", "c1", "c2"] and got["c3"] != got["c4"]
    assert got["e"] == got["e2"] == "e" and got["long"] == got["long2"] and "n" not in got and None not in got


def test_no_forms(spark, work):
    assert groups(spark, work, []) == {}


def test_collisions_of_fingerprints_are_told_apart(spark, work, monkeypatch):
    # equal fingerprints for all: the exact comparison must still part the texts
    @F.pandas_udf(formatting._FP)
    def same(forms):
        import pandas as pd

        return pd.DataFrame({"f1": [1] * len(forms), "f2": [2] * len(forms)})

    same.__doc__ = None
    monkeypatch.setattr(formatting, "fingerprints", same)
    got = groups(spark, work, [("a", "x = 1"), ("b", "X=1"), ("c", "y = 2"), ("d", "z"), ("e", "Y2")])
    assert got == {"a": "a", "b": "a", "c": "c", "e": "c", "d": "d"}


def test_structure_equals_fingerprint():
    for s in SAME[:1] + SAME[2:4]:
        f = re.sub("[^\\w{}()\\[\\],:=]+|_", "", re.sub(r"[=!<>:+\-*/%&|^@]=+", "", s.lower()))
        a = re.sub("[^\\w{}()\\[\\],:=]+|_", "", A.lower())
        assert formatting.fingerprint(f) == formatting.fingerprint(a) and formatting.structure(f) == formatting.structure(a)


def shingles(text, size):
    w = [x.lower() for x in re.findall(r"[A-Za-z0-9_]+", text)]
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def brute(rows, threshold, size):
    first = {}
    for s, i, t in rows:
        if t is not None and shingles(t, size):
            first[s, t] = min(i, first.get((s, t), i))
    items = [(s, i, shingles(t, size)) for (s, t), i in first.items()]
    parent = {(s, i): (s, i) for s, i, _ in items}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (s, i, a) in enumerate(items):
        for r, j, b in items[:k]:
            if r == s and len(a & b) >= threshold * len(a | b) - 1e-12:
                x, y = sorted((root((s, i)), root((r, j))))
                parent[y] = x
    least = {}
    for x in parent:
        least[root(x)] = min(least.get(root(x), x[1]), x[1])
    return {x: least[root(x)] for x in parent}


def make(seed, n=140):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    rows, texts = [], []
    for i in range(n):
        if texts and rnd.random() < 0.7:
            w = rnd.choice(texts).split()
            for _ in range(rnd.randrange(6)):
                w[rnd.randrange(len(w))] = rnd.choice(words)
            if rnd.random() < 0.2:
                cut = rnd.randrange(len(w))
                w = w[cut:] + w[:cut]
        else:
            w = ["same", "start", "here"] + [rnd.choice(words) for _ in range(rnd.randrange(3, 40))]
        texts.append(" ".join(w))
        rows.append((rnd.choice(["p", "q"]), i * 3, texts[-1]))
    rows += [("p", 9001, texts[0]), ("p", 9002, texts[0].upper()), ("p", 9003, None), ("q", 9004, ""), ("q", 9005, "one two"), ("q", 9006, "a b c")]
    return rows


# keys of all kinds: paired in one task, given up there, and hot by the sketch
@pytest.mark.parametrize("threshold,size,key_rows,hot_rows", [(0.5, 3, 20_000, None), (0.5, 3, 3, 10**6), (0.5, 3, 3, 3), (0.8, 5, 20_000, None), (0.3, 2, 5, None)])
def test_near_groups_equal_brute_force(spark, work, threshold, size, key_rows, hot_rows):
    rows = make(11 + key_rows)
    df = spark.createDataFrame(rows, "record_set string, id long, text string").repartition(5)
    got = {(r["record_set"], r["id"]): r["group"] for r in near.near_groups(df, work, threshold, size, key_rows, hot_rows).collect()}
    assert got == brute(rows, threshold, size)


def test_near_groups_of_nothing(spark, work):
    df = spark.createDataFrame([], "record_set string, id long, text string")
    assert near.near_groups(df, work).count() == 0


def test_match_threshold_bounds_the_loss():
    from math import comb

    for t in (0.3, 0.5, 0.8, 1.0):
        m, k = near.match_threshold(t), near.COORDINATES
        tail = sum(comb(k, i) * t**i * (1 - t) ** (k - i) for i in range(m))
        assert tail <= near.LOSS and (m == k or tail + comb(k, m) * t**m * (1 - t) ** (k - m) > near.LOSS)


def test_one_text_with_small_edits_a_thousand_times(spark, work):
    # one hot key in every coordinate, and few texts beside it
    rows = [("p", i, " ".join(f"w{k}" if k != i % 40 else f"x{i}" for k in range(40))) for i in range(1000)]
    rows += [("p", 5000 + i, " ".join(f"v{k + 100 * i}" for k in range(20)) + " w1 w2 w3 w4") for i in range(50)]
    df = spark.createDataFrame(rows, "record_set string, id long, text string").repartition(5)
    got = {r["id"]: r["group"] for r in near.near_groups(df, work, 0.5, 3, 20, 20, hot_pairs=50).collect()}
    assert {got[i] for i in range(1000)} == {0} and all(got[5000 + i] == 5000 + i for i in range(50))


def test_packed_sets_come_back():
    import numpy as np

    x = np.array([0, 1, 255, (1 << near.BITS) - 1], "uint64")
    assert (near.unpack_set(near.pack_set(x)) == x).all() and near.overlap(x, x[1:]) == 3 and near.overlap(x, x[:0]) == 0
