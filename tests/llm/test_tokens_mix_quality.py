import base64
import os
import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evalspan.llm import mixing, quality, tokens

if not os.path.exists(tokens.VOCABULARY):
    pytest.skip("no vocabulary", allow_module_level=True)


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    with open(tokens.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    with open(tokens.VOCABULARY, "rb") as f:
        return tokens.Encoder(f.read())


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80) | st.text("ab c\n'stné中", max_size=200))
def test_ids_equal_a_reference(reference, encoder, text):
    assert encoder.encode(text) == reference.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 4000, "ab" * 5000, "中文" * 800, "<|endoftext|>", "~" * 2999, "\n" * 500, " \t" * 300])
def test_long_pre_tokens(reference, encoder, text):
    assert encoder.encode(text) == reference.encode_ordinary(text)
    assert not encoder.queue.top and not any(encoder.queue.low)


def test_rank_queue_order():
    q, rnd, want = tokens.RankQueue(50_000), random.Random(2), []
    for _ in range(2000):
        item = (rnd.randrange(50_000) if rnd.random() < 0.5 else 7, rnd.randrange(1000))
        q.push(*item)
        want.append(item)
    assert [q.pop() for _ in want] == sorted(want) and q.pop() is None


def test_encode_table(spark, work, reference):
    df = spark.createDataFrame([(1, "hello world", "x"), (2, "", None), (3, None, "y")], "doc_id long, text string, ids2 string")
    got = {r["doc_id"]: (r["ids"], r["ids2"]) for r in tokens.encode(df, "text").collect()}
    assert got == {1: (reference.encode_ordinary("hello world"), "x"), 2: ([], None), 3: ([], "y")}
    sizes = {r["doc_id"]: r["tokens"] for r in tokens.count_tokens(df, "text").collect()}
    assert sizes == {1: 2, 2: 0, 3: 0} and tokens.encode(df.limit(0), "text").count() == 0


def mixed(spark, work, sizes, targets, size=None, buckets=None):
    rows = [(i, s, n, i if h is None else h, 0) for i, (s, n, h) in enumerate(sizes)]
    t = spark.createDataFrame(rows, "doc_id long, source string, tokens long, h1 long, h2 long")
    g = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    uses, plan = mixing.mix(t, g, work, size)
    return [r.asDict() for r in uses.orderBy("position", "doc_id", "copy").collect()], plan, uses


def test_shares_repeats_and_order(spark, work, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_TEXTS", 20)
    rnd = random.Random(1)
    sizes = [("a", rnd.randrange(5, 40), None) for _ in range(300)] + [("b", rnd.randrange(5, 40), None) for _ in range(40)] + [("c", 10, None)] * 5
    sizes += [("a", 7, 3), (None, 5, None), ("zzz", 9, None), ("a", 0, None)]
    targets = [("A", 0.5, 1), ("b ", 0.4, 4), ("c", 0.1, 2), ("d-e", None, 3), (None, 0.3, 1)]
    uses, plan, df = mixed(spark, work, sizes, targets)
    total, by, copies = sum(u["tokens"] for u in uses), defaultdict(int), defaultdict(set)
    for u in uses:
        by[u["source"]] += u["tokens"]
        assert u["copy"] not in copies[u["doc_id"]]
        copies[u["doc_id"]].add(u["copy"])
    for p in plan:
        assert abs(by.get(p.source, 0) - p.wanted) <= 40
    caps = {"a": 1, "b": 4, "c": 2}
    assert all(len(c) <= caps[sizes[d][0]] for d, c in copies.items()) and set(by) == {"a", "b", "c"}
    assert by["c"] == 100  # all that its repeats allow
    out = {r["source"]: r for r in mixing.shares(df, plan).collect()}
    assert abs(out["a"]["actual_share"] - by["a"] / total) < 1e-9 and out["d_e"]["used_tokens"] == 0
    # the curriculum: the repeated source's share rises along the mix
    half, seen = defaultdict(int), 0
    for u in uses:
        half[u["source"], seen * 2 >= total] += u["tokens"]
        seen += u["tokens"]
    assert half["b", True] > 1.2 * half["b", False] and half["a", True] < half["a", False]


def test_empty_mix(spark, work):
    uses, plan, df = mixed(spark, work, [], [("a", 1.0, 2)])
    assert uses == [] and mixing.shares(df, plan).first()["actual_share"] is None


SCHEDULES = [[(0, 1 - r), (1, 1 + r)] for r in (-1.0, -0.4, 0.0, 0.7, 1.0)] + [[(0.5, 3)], [(0, 0), (0.3, 2), (0.6, 0), (0.8, 0), (1, 5)], [(0.2, 1), (0.9, 4)]]


def test_due_time_inverts_the_integral(spark):
    normal = [mixing.normal_schedule(s) for s in SCHEDULES]
    rows = [(i, u / 20.0, [t for t, _ in s], [w for _, w in s]) for i, s in enumerate(normal) for u in range(21)]
    df = spark.createDataFrame(rows, "i int, u double, times array<double>, weights array<double>")
    for r in df.withColumn("t", mixing.due_time(F.col("u"), F.col("times"), F.col("weights"))).collect():
        done, points = 0.0, normal[r["i"]]
        for (s, v), (t, w) in zip(points, points[1:]):
            e = min(max(r["t"], s), t)
            done += (e - s) * (2 * v + (w - v) * (e - s) / (t - s)) / 2
        assert abs(done - r["u"]) < 1e-9, r
    for bad in ([], [(2, 1)], [(0, -1), (1, 3)], [(0, 0)], [(0.5, 1), (0.5, 2)]):
        with pytest.raises(ValueError):
            mixing.normal_schedule(bad)


def test_a_schedule_of_ones_own(spark, work):
    # b only in the second half
    t = spark.createDataFrame([(i, "ab"[i % 2], 10, i, 0) for i in range(200)], "doc_id long, source string, tokens long, h1 long, h2 long")
    g = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    uses, _ = mixing.mix(t, g, work, schedules={"a": [(0, 1)], "b": [(0.5, 0), (0.51, 1)]})
    at = [(r["source"], r["position"]) for r in uses.collect()]
    assert min(p for s, p in at if s == "b" and p > 0) > 990 and sum(s == "b" for s, _ in at) == 100


COMMON = frozenset("the a of to and in was der die 的 了 在".split())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["the cat sat. ", "x = 1\n", "| a | b |\n", "word ", "中文的。", "\r\n", "  ", "- item\n", "~~~", "a,b,c\n"]), max_size=40), st.lists(st.integers(0, 200), max_size=5), st.randoms())
def test_chunks_join_to_the_whole(parts, cuts, rnd):
    text = "".join(parts)
    at = sorted({0, len(text), *[c for c in cuts if c < len(text) and (text[c - 1 : c].isspace() and text[c - 1] != "\r")]})
    states = [quality.unpack(quality.pack(quality.read_text(text[a:b], COMMON))) for a, b in zip(at, at[1:])] or [quality.read_text("", COMMON)]
    while len(states) > 1:
        i = rnd.randrange(len(states) - 1)
        states[i : i + 2] = [quality.join_states(states[i], states[i + 1], COMMON)]
    whole = quality.shares(quality.finish(quality.read_text(text, COMMON)))
    joined = quality.shares(quality.finish(states[0]))
    for k in ("chars", "words", "mean_word_length", "symbol_ratio", "digit_ratio", "common_share", "lines", "ended_line_share"):
        assert joined[k] == whole[k], k


PROSE = (
    "The agent removed the broken test early in the morning, and our reviewer kept a copy of it for another week. "
    "Later everything was restored by two members of the team because nobody had asked them about that change.\n"
)
OTHER = [
    "\n".join(f"- item {i}" for i in range(20)), "\n".join(f"| a{i} | {i} | x |" for i in range(20)), "def f(x):\n    return x + 1\n" * 9,
    "~" * 300, "QUJD" * 100, "2026-01-01T00:00:00 [INFO] x\n" * 9, "\n".join(f"v{i},3,NA,{i}" for i in range(9)), "the same words " * 40,
]


def test_the_indent_does_not_hide_a_lines_kind():
    for line, kind in (("2024-01-02 10:11:12 started", "log"), ("- a small point", "list"), ("result_of_the_long_name_value = start_value", "code")):
        for indent in ("", " " * 12, " " * 45, "\u00a0" * 50):
            assert quality.kind_of(quality.read_line(indent + line, frozenset())) == kind
            for cut in (10, len(indent), len(indent) + 3):  # the indent may lie in another chunk
                a, b = (quality.read_line(x, frozenset()) for x in ((indent + line)[:cut], (indent + line)[cut:]))
                assert quality.kind_of(quality.join_lines(a, b, frozenset())) == kind


def test_statistics_of_a_table(spark, work):
    rows = [(1, PROSE * 3), (2, PROSE * 40), (3, None), (4, ""), (5, " \n "), (6, "x"), (7, PROSE * 3 + "\n- one\n- two\n"), (8, "\n".join(["- item"] * 2000))]
    rows += [(10 + i, t) for i, t in enumerate(OTHER)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kind", F.lit("clash")).withColumn("chars", F.lit(1))
    words = spark.createDataFrame([(w,) for w in COMMON] + [(None,)], "word string")
    out = quality.text_statistics(df, "doc_id", "text", words, work, chunk=600)
    got = {r["doc_id"]: r for r in out.collect()}
    assert set(got) == {r[0] for r in rows if r[1] is not None} and got[4]["chars"] == got[5]["chars"] == 0 and got[4]["kind"] is None
    assert all(got[i]["prose_share"] > 0.5 for i in (1, 2, 7)) and all(got[i]["prose_share"] < 0.5 for i in (8, *range(10, 10 + len(OTHER))))
    one = quality.shares(quality.finish(quality.read_text(PROSE * 40, frozenset(COMMON))))
    assert {k: got[2][k] for k in one} == one
    assert quality.text_statistics(df.limit(0), "doc_id", "text", words, work.__class__(spark, "none")).count() == 0
