import json

import pytest

from millrace.operators import models as M


def test_retries_and_classes():
    calls, waits = [], []

    def ask(p):
        calls.append(p)
        if len(calls) < 3:
            raise M.ModelError("busy", 429, 99.0 if len(calls) == 1 else None)
        return "ok"

    assert M.with_retries(ask, sleep=waits.append, seed=1)("x") == "ok" and waits[0] == 30.0 and 1 <= waits[1] <= 3
    for e, n in ((M.Refusal("no", 500), 1), (M.ModelError("bad", 400), 1), (M.ModelError("down", 503), 3)):
        calls.clear()

        def fail(p, e=e):
            calls.append(p)
            raise e

        with pytest.raises(M.ModelError):
            M.with_retries(fail, sleep=waits.append)("x")
        assert len(calls) == n
    assert M.is_size_failure(M.ModelError("context length exceeded")) and M.is_size_failure(M.ModelError("", 413)) and not M.is_size_failure(M.ModelError("no key", 401)) and not M.is_size_failure(M.Refusal("too long"))


def test_halving():
    assert M.halve("a\n\nbbb\nc") == ("a\n\n", "bbb\nc") and M.halve("ab\ncd\nef") == ("ab\n", "cd\nef") and M.halve("abcd") == ("ab", "cd")

    def ask(t):
        if len(t) > 600:
            raise M.ModelError("too large")
        return t

    text = "line of text\n" * 150
    assert "".join(M.ask_halving(ask, text, least=100)) == text
    with pytest.raises(M.ModelError):
        M.ask_halving(ask, text, depth=0)


def test_summaries():
    count = lambda t: len(t.split())
    assert M.summarise(lambda t: "s", "a b", count, 5, 10) == "a b"
    assert M.summarise(lambda t: f"s{count(t)}", "a " * 8, count, 5, 10) == "s8"
    long = M.summarise(lambda t: " ".join(t.split()[:3]), "\n".join(f"w{i} x y z" for i in range(40)), count, 5, 20)
    assert 0 < count(long) <= 20
    assert M.pack_texts(["a a", "b", "c c c", "d d d d d"], count, 4) == [["a a", "b"], ["c c c"], ["d d d d d"]]


def test_columns(spark):
    splits = spark.createDataFrame([(1, 0, "x y"), (1, 1, " "), (2, 0, "fail")], "doc_id int, split_sequence int, text string")

    def maker():
        def ask(t):
            if t == "fail":
                raise M.ModelError("no", 400)
            return json.dumps([{"name": w} for w in t.split()])

        return ask

    got = [(r.doc_id, r.place, r.payload.name) for r in M.extract_mentions(splits, maker, "struct<name:string>").collect()]
    assert sorted(got) == [(1, 0, "x"), (1, 1, "y")]
    headings = spark.createDataFrame([(1, i, t) for i, t in enumerate(["T", "a", "b"])] + [(2, 0, "fail")], "doc_id int, pos int, text string")
    judge = lambda: lambda t: json.dumps(["title" if x == "T" else "h2" for x in json.loads(t)]) if "fail" not in t else "[]"
    assert {(r.doc_id, r.pos): r.judgment for r in M.judge_headings(headings, judge, 2).collect()} == {(1, 0): "title", (1, 1): "h2", (1, 2): "h2", (2, 0): None}
    images = spark.createDataFrame([("a", None, "c"), ("b", "kept", "c"), ("d", None, "deco")], "id string, text_representation string, context string")
    see = lambda: lambda c: json.dumps({"summary": "seen", "decorative": c == "deco"})
    assert {r.id: r.text_representation for r in M.describe_images(images, see).collect()} == {"a": "seen", "b": "kept", "d": None}
