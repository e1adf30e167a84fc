import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import winnowing
from millrace.llm.winnowing import digest, edited_likeness, fingerprint_documents, gram_hashes, likeness, winnow


def brute_winnow(text, k, w):
    grams = [text[i : i + k] for i in range(max(1, len(text) - k + 1))] if text else []
    hs = [int(gram_hashes(np.array(list(map(ord, g)), np.uint32), k)[0]) for g in grams]
    kept = set()
    for i in range(max(1, len(hs) - w + 1) if hs else 0):
        part = hs[i : i + w]
        kept.add(max(i + j for j, h in enumerate(part) if h == min(part)))
    return sorted(kept), [hs[p] for p in sorted(kept)]


@settings(max_examples=150, deadline=None)
@given(st.text("ab é🙂", max_size=60), st.integers(1, 9), st.integers(1, 9))
def test_winnow_matches_its_definition(text, k, w):
    pos, h = winnow(text, k, w)
    assert (pos.tolist(), h.tolist()) == brute_winnow(text, k, w)


def test_stretches_do_not_show(monkeypatch):
    text = "".join(random.Random(1).choices("abcd ", k=900)) + "z" * 300
    want = winnow(text, 5, 7)
    monkeypatch.setattr(winnowing, "_STRETCH", 64)
    got = winnow(text, 5, 7)
    assert (want[0] == got[0]).all() and (want[1] == got[1]).all()


def test_shared_passages_are_always_found():
    rng = random.Random(2)
    for _ in range(50):
        shared = "".join(rng.choices("abcdefg", k=winnowing.K + winnowing.WINDOW - 1))
        a, b = ("".join(rng.choices("hijklm", k=200)) + shared + "".join(rng.choices("hijklm", k=90)) for _ in "ab")
        assert set(winnow(a)[1].tolist()) & set(winnow(b)[1].tolist())


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for i, (doc, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        e = t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]
        (p, h), (q, g), (_, f) = winnow(t), winnow(e), winnow(nxt)
        out.append((doc, len(t), hashlib.sha256(e.encode()).hexdigest(), digest(p, h), digest(q, g), likeness(np.unique(h), np.unique(g)), likeness(np.unique(h), np.unique(f))))
    return sorted(out, key=str)


def test_documents_against_brute_force(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 9)))
    rows = [(rng.randrange(-50, 5000), " ".join(word() for _ in range(rng.choice([0, 1, 3, 50, 400])))) for _ in range(400)]
    rows += [(None, "no id"), (None, None), (7, ""), (8, None), (1 << 60, "y" * 50000), *rows[:30]]
    df = spark.createDataFrame([(a, b, 1, "c") for a, b in rows], "doc_id long, text string, id int, trailer string").repartition(7)
    got = edited_likeness(df)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
    for few in ([(1, "only one here")], [(1, "ab"), (2, None)], []):
        df = spark.createDataFrame(few, "doc_id long, text string")
        assert sorted(map(tuple, edited_likeness(df).collect()), key=str) == brute(few)


def test_many_cuts_are_placed_alike(spark, monkeypatch):
    rows = [(i * 3 % 1009, f"text number {i} " * 3) for i in range(700)]
    monkeypatch.setattr(winnowing, "shuffle_partitions", lambda s: 100)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, edited_likeness(df).collect()), key=str) == brute(rows)


def test_positions_are_kept(spark):
    df = spark.createDataFrame([(1, "some text that is long enough to have several windows in it"), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in fingerprint_documents(df).collect()}
    pos, h = winnow("some text that is long enough to have several windows in it")
    assert rows[1].positions == pos.tolist() and rows[1].hashes == h.astype(np.int64).tolist() and rows[2].positions == []
