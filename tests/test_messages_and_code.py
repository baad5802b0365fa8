import json

import pytest
from pyspark.sql import functions as F

from evalspan.functions import code
from evalspan.functions import scalars as fn
from evalspan.operators import messages as msg


def call(name, arguments, cid="c1"):
    return {"role": "assistant", "message_type": "action", "tool_calls": [{"id": cid, "function": {"name": name, "arguments": arguments}}]}


def logs(spark, *rows):
    return spark.createDataFrame([(f"t{i}", r if isinstance(r, str) or r is None else json.dumps(r)) for i, r in enumerate(rows)], "k string, m string")


def calls(spark, *rows):
    return msg.tool_calls(msg.messages(logs(spark, *rows), "m", ["k"]), ["k"])


def test_only_readable_edits_are_kept(spark):
    log = [
        call(msg.EDITOR, json.dumps({"command": "view", "path": "/a"})), call(msg.EDITOR, json.dumps({"command": "insert", "path": "/b"})),
        call(msg.EDITOR, {"command": "create", "path": "/c"}), call(msg.EDITOR, "{broken"), call("bash", json.dumps({"command": "create"})),
        {"role": "user", "content": "x"},
    ]
    got = msg.structured_edits(calls(spark, log, None, "not json", [], "")).orderBy("message_index").collect()
    assert [(r["command"], r["path"]) for r in got] == [("insert", "/b"), ("create", "/c")]


def test_suspicious_commands(spark):
    commands = [
        ("sed -i s/a/b/ x", ["sed_in_place"]), ("grep -rn x . 2>&1", []), ("echo a > b.txt", ["shell_redirect"]), ("GIT reset --hard", ["git_mutation"]),
        ("cd /w && rm -rf .d && d init", ["filesystem_command"]), ("rm /w/a.py", ["filesystem_command"]), ("ls | tee x; patch -p1", ["patch_command", "tee"]),
        ("python -c \"open('a', 'w').write(1)\"", ["python_open_write"]), ("perl -pi -e x", ["perl_in_place"]), ("p.write_text (1)", ["python_write_text"]),
    ]
    log = [call("bash", json.dumps({"command": c})) for c, _ in commands]
    got = [r["labels"] for r in msg.shell_commands(calls(spark, log, [call("bash", "{bad")])).orderBy("k", "message_index").collect()]
    assert got == [*[labels for _, labels in commands], []]
    undo = [call(msg.EDITOR, json.dumps({"command": "undo_edit"}))]
    assert msg.undo_calls(calls(spark, undo, log)).count() == 1


def test_last_response_decides(spark):
    log = [
        call(msg.EDITOR, json.dumps({"command": "create", "path": "/c"})),
        {"role": "tool", "tool_call_ids": ["c1"], "content": "failed"},
        {"role": "tool", "tool_call_ids": ["c1"], "content": [{"text": "OBSERVATION:\n"}, {"text": "File created successfully at: /c"}]},
    ]
    m = msg.messages(logs(spark, log), "m", ["k"])
    (r,) = msg.edit_outcomes(msg.structured_edits(msg.tool_calls(m, ["k"])), msg.responses(m, ["k"]), ["k"]).collect()
    assert r["succeeded"] and r["first_line"] == "File created successfully at: /c"


def test_patch_alignment_classes(spark):
    diff = "diff --git a/a.py b/a.py\n"
    data = [("", ["a.py"]), (None, []), (diff, ["a.py", "b.py"]), (diff, ["b.py"]), (diff, [])]
    df = spark.createDataFrame(data, "p string, c array<string>")
    got = [r[0] for r in df.select(msg.patch_alignment(F.col("p"), F.col("c"))).collect()]
    assert got == [msg.EMPTY, msg.EMPTY, msg.ALIGNED, msg.DISJOINT, msg.NO_EDIT]


def test_patch_paths_of_both_sides(spark):
    df = spark.createDataFrame([("diff --git a/x.py b/y.py\n@@ -1 +1 @@\ndiff --git a/z b/z\n",), ("",), (None,)], "p string")
    got = [tuple(r) for r in df.select(fn.patch_paths(F.col("p")), fn.patch_paths(F.col("p"), "b")).collect()]
    assert got == [(["x.py", "z"], ["y.py", "z"]), ([], []), (None, None)]
    bad = spark.createDataFrame([("diff --git a/x.py b/x.py\ndiff --git broken\n",)], "p string")
    assert bad.select(fn.patch_paths(F.col("p"), "b")).first()[0] == [] and bad.select(fn.patch_paths(F.col("p"))).first()[0] == ["x.py"]


def test_edits_on_text(spark):
    df = spark.createDataFrame([("a b a",), ("b",), (None,)], "t string")
    got = [tuple(r) for r in df.select(fn.replace_once(F.col("t"), F.lit("b"), F.lit("x")), fn.fits_once(F.col("t"), F.lit("a")), fn.insert_at_line(F.col("t"), F.lit(1), F.lit("new"))).collect()]
    assert got == [("a x a", 2, "a b a\nnew"), ("x", 0, "b\nnew"), (None, None, None)]


def test_replay():
    edits = [{"command": "create", "path": "p", "text": "a\nb"}, {"command": "str_replace", "path": "p", "old": "b", "text": "c"}, {"command": "insert", "path": "p", "line": 0, "text": "z"}]
    assert code.replay(edits) == {"p": "z\na\nc"}
    for bad in ([edits[0], edits[0]], [edits[0], {"command": "str_replace", "path": "p", "old": "", "text": ""}], [{"command": "create", "path": "/r/../x", "text": ""}], [edits[1]]):
        with pytest.raises(ValueError):
            code.replay(bad)


def test_paths_stay_under_their_root():
    assert [code.confined(p, "/testbed") for p in ("a/b.py", "/testbed/a/../b", "./x", "/testbed//y")] == ["a/b.py", "b", "x", "y"]
    for p in ("../../etc/x", "/etc/x", "/testbed/../x", "", None, "/testbed", "/testbedded/x"):
        with pytest.raises(ValueError):
            code.confined(p, "/testbed")


def test_confident_levels_and_feedback(spark):
    assert fn.confident_levels(4) == [(0, 4)] and (0, 1) not in fn.confident_levels(16) and (0, 16) in fn.confident_levels(16)
    data = [(True, 3, 5, 1, None, None), (False, 0, 0, 0, "timeout", True), (None, None, None, None, None, False)]
    df = spark.createDataFrame(data, "v boolean, p int, t int, e int, r string, i boolean")
    got = [r[0] for r in df.select(fn.feedback_text(*[F.col(c) for c in "vpteri"])).collect()]
    assert got == ["Public tests: 3/5 passed; exitcode=1.", "Previous edit was invalid; source unchanged. Public tests unavailable: timeout.", "Public tests unavailable: invalid_observation."]


def test_replay_over_trajectories(spark):
    data = [("t1", 0, "create", "p", "a a", None, None), ("t1", 1, "str_replace", "p", "x", "a", None), ("t2", 0, "create", "p", "a", None, None), ("t2", 1, "insert", "p", "b", None, 1)]
    df = spark.createDataFrame(data, "k string, i int, command string, path string, text string, old string, line int")
    got = {r["k"]: (r["text"], r["error"]) for r in code.replay_edits(df, ["k"], ["i"]).collect()}
    assert got == {"t1": (None, "not exactly one place"), "t2": ("a\nb", None)}


def test_values_hunks_status_and_trees():
    value = {"a": (1, b"\x00", [None, (2,)])}
    assert code.decode_value(json.loads(json.dumps(code.encode_value(value)))) == value
    assert code.canonical_json('{"b": [1, {"d":2,"c":"é"}], "a": null}') == '{"a":null,"b":[1,{"c":"é","d":2}]}'
    assert code.canonical_json("{") is None and code.canonical_json(None) is None
    patch = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -3,3 +3,2 @@\n keep\n-gone\n-too\n+new\n"
    assert code.removed_lines(patch) == [4, 5] and code.removed_lines(None) == []
    assert [(e["path"], e["kind"]) for e in code.status_lines(" M a.py\n?? b\nR  c -> d")] == [("a.py", "modified"), ("b", "untracked"), ("d", "renamed")]
    src = "def f(x):\n    return x\n\nclass C:\n    def g(self):\n        pass\n"
    assert code.functions_of(src) == ["f"] and code.functions_of("def (") is None
    assert code.enclosing(src, 6) == "C.g" and code.enclosing(src, 4) is None
    assert "return 2" in code.replace_body(src, "f", "return 2")
    with pytest.raises(ValueError):
        code.replace_body(src, "missing", "pass")
    assert [code.kind_of_annotation(a, d) for a, d in (("Optional[int]", None), (None, "'x'"), (None, None))] == ["int", "str", "any"]


def test_vectorised_wrappers(spark):
    df = spark.createDataFrame([('{"b":1, "a":2}',), (None,)], "t string")
    assert [r[0] for r in df.select(code.canonical_json_of("t")).collect()] == ['{"a":2,"b":1}', None]


def test_scalar_texts(spark):
    df = spark.createDataFrame([("own__repo.1a2b.func_basic__x",), ("plain",), (None,)], "t string")
    k = F.col("t")
    got = [tuple(r) for r in df.select(fn.repo_key(k), fn.profile_id(k), fn.family(k), fn.slug(k)).collect()]
    assert got[0] == ("own__repo", "own__repo.1a2b", "func_basic", "own_repo_1a2b_func_basic_x")
    assert got[1] == ("plain", "plain", "plain", "plain") and got[2] == (None,) * 4
    import hashlib

    d = df.limit(1).select(fn.joined_hash(k, F.lit(3))).first()[0]
    assert d == hashlib.sha256(b"own__repo.1a2b.func_basic__x\x003").hexdigest()
    tagged = spark.createDataFrame([("a <x>\n one \n\n two</x> b",), ("none",)], "t string").select(fn.tagged_lines(F.col("t"), "x"))
    assert [r[0] for r in tagged.collect()] == [["one", "two"], []]
