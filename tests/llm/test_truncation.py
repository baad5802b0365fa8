from pyspark.sql import functions as F

from evalspan.llm import truncation


def kinds(text):
    return dict(zip(truncation.END_SCHEMA.names, truncation.end_state(text)))


def test_end_states():
    assert kinds("x = f(1)\nreturn x")["kind"] == "terminal" and kinds("x = f(1)\nreturn x")["known"]
    assert not kinds("value = 1\nreturn val")["known"]
    assert kinds("```python\nreturn 1\n```\nAll done.")["kind"] == "sentence" and not kinds("```python\nreturn 1\n```")["fence"]
    assert kinds("```python\nreturn 1")["fence"]
    assert kinds('x = {"a": 1, "b')["quote"] and kinds("x = f(1, (2")["depth"] == 2
    assert kinds("x = strip)(1\nreturn x")["depth"] == 0  # wrong syntax further up isn't an open end
    assert kinds("if a:\n    return f(x …")["marker"] and kinds("x = a [cut]")["marker"] and not kinds("return x[0]")["marker"]
    assert not kinds("...")["marker"] and kinds("a\ufffd")["broken"] and kinds("x = '\\u00")["broken"]
    assert kinds("if a:\n    return 1")["inner"]
    assert kinds("# don't stop (here\nreturn 1")["depth"] == 0
    assert kinds("<p>The story was about a man who")["markup"] and kinds('<div class="a"><b>x</b')["markup"]
    assert not any(kinds(t)["markup"] for t in ("<p>All of it.</p>\nDone", "if a<b and c>d:\n    return a", "x = '<p>'\nreturn x", "a <br> b"))
    assert all(kinds(t)["broken"] for t in ("x = '\\U0001F", "x = '\\N{DASH", "caf\u00c3\u00a9 and \u00c3", "a\ufffd"))
    assert not any(kinds(t)["broken"] for t in ("a caf\u00e9", "x = '\\\\U00'", "x = '\\N{DASH}'"))
    assert kinds("He said \u201cthis is")["quote"] and not kinds("\u201eJa\u201c, \u201cyes\u201d")["quote"]


def test_whole_and_cut_rows(spark, work):
    whole = [(i, "m", f"x{i} = f({i})\nreturn x{i}", 10) for i in range(40)]
    sentences = [(100 + i, "m", f"x = {i}\nreturn x\n\n# Note that it may be empty", 12) for i in range(12)]
    full = "y = 1\n" * 20 + "return y"
    limit = [(200 + i, "cap", (full + "\n" + "z" * 300)[:100] if i else full[:100], 30) for i in range(5)]
    cut = [(300, "m", "x = f(1,\n   ", 9), (301, "M ", "x = 1\ny = 2", 9), (302, None, "```\nreturn 1", 9), (303, "m", "# This change does\n", None)]
    other = [(400, "m", None, 5), (401, "m", "", 5), (402, "m", "  ", 5), (403, "m", "return " + "x" * 50000, 9)]
    df = spark.createDataFrame(whole + sentences + limit + cut + other, "id long, model string, text string, tokens int")
    for name in ("source", "kind", "chars", "_t", "reason"):
        df = df.withColumn(name, F.lit(1))
    out = truncation.find_truncated(df, "id", "text", "model", "tokens", work)
    got = {r["id"]: (r["source"], r["reason"]) for r in out.collect()}
    assert {i for i, (_, reason) in got.items() if reason} == {200, 201, 202, 203, 204, 300, 301, 302, 303} - {i for i in got if not got[i][1]}
    assert not any(got[i][1] for i in [*range(40), *range(100, 112)]) and not {400, 401, 402} & set(got)
    assert got[301] == ("m", "no closing statement") and got[302][0] is None
    rates = {r["source"]: r["cut"] for r in truncation.truncation_rates(out).collect()}
    assert rates["m"] >= 3 and rates[None] == 1


def reasons(spark, work, rows):
    df = spark.createDataFrame(rows, "id long, model string, text string, tokens int")
    return {r["id"]: r["reason"] for r in truncation.find_truncated(df, "id", "text", "model", "tokens", work).collect()}


def test_mid_code_is_cut_in_a_source_that_mostly_cuts(spark, work):
    rows = []
    for m in ("copies", "limit", "all", "open"):
        rows += [(len(rows) + i, m, f"x{i} = f({i})\nreturn x{'0' * i}{i}", None) for i in range(0 if m == "all" else 20)]
        if m == "copies":
            cut = [f"{m} = 1\ny = z"] * 30
        elif m == "open":  # most are cut behind an open bracket, a few in mid-code
            cut = [f"x = f({i}, (" for i in range(30)] + [f"y{i} = 1\ny = z" for i in range(10)]
        else:
            cut = [f"n{i:03} = 1\n" + "y = 1\n" * 10 + "y = z" for i in range(30)]
        rows += [(len(rows) + i, m, t, None) for i, t in enumerate(cut)]
    got = reasons(spark, work, rows)
    assert all((got[i] is None) == ("return" in t) for i, _, t, _ in rows)
    inner = [(i, "inner", f"n{i:03} = 1\n" + "if a:\n    return n", None) for i in range(10)]
    assert set(reasons(spark, work, inner).values()) == {"inner statement"}


def test_a_source_of_another_style_stays_whole(spark, work):
    rows = [(i, "style", f"x = {i}\n" + "run(x)\n" * (i % 9 + 1) + "stop" * i, None) for i in range(40)]
    rows += [(100 + i, *rows[-1][1:]) for i in range(5)]  # copies of the longest text are no limit
    assert set(reasons(spark, work, rows).values()) == {None}


def test_usual_endings_are_counted_per_source_over_texts(spark, work):
    note = "x = {0}\nreturn x\n\n# Note that {1}"
    cut = [(i, "m", note.format(1, "this change of the"), None) for i in range(20)]  # copies
    cut += [(20 + i, m, note.format(2, "one or two"), None) for i, m in enumerate(("m", "a", "b", "c"))]
    cut += [(30 + i, "m", note.format(i, f"word{i} is another"), None) for i in range(2)]  # two texts cut alike
    whole = [(100 + i, "small", note.format(i, "the list is new"), None) for i in range(6)]
    whole += [(200 + i, "m", note.format(i, "it may be empty"), None) for i in range(12)]
    whole += [(300, "single", note.format(99, "it may be empty"), None)]  # usual elsewhere
    for size in (0, 300):  # the same rows are judged alike beside many others
        more = [(1000 + i, "large", note.format(i, "no row may be empty"), None) for i in range(size)]
        got = reasons(spark, work, cut + whole + more)
        assert {got[r[0]] for r in cut} == {"open sentence"}
        assert {got[r[0]] for r in whole + more} == {None}


def test_rates_do_not_depend_on_partitions(spark, work):
    rows = [(i, f"m{i % 3}", f"x{i} = f({i})\nreturn x{'0' * (i % 7)}{i}" + "y" * (i % 5), i % 40) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, model string, text string, tokens int")
    found = [sorted(map(tuple, truncation.find_truncated(df.repartition(n), "id", "text", "model", "tokens", work).collect()), key=str) for n in (1, 7)]
    assert found[0] == found[1]
    # brute force of the baseline: the first step of the histogram that 95 % don't exceed
    texts = df.selectExpr("model as source", "tokens / length(text) as ratio")
    for r in truncation._high_ratios(texts).collect():
        own = sorted(x["ratio"] for x in texts.where(F.col("source") == r["source"]).collect())
        assert abs(r["ratio95"] - own[-(-95 * len(own) // 100) - 1]) <= 0.001


def test_empty_table(spark, work):
    df = spark.createDataFrame([], "id long, model string, text string, tokens int")
    assert truncation.find_truncated(df, "id", "text", "model", "tokens", work).count() == 0
