import random

import pytest

from millrace.functions.tokenizers import Vocabulary, Widest, Words, resolve, set_default
from millrace.operators import cascade as C

W = Words()


def el(kind, text, level=0):
    return C.Element(kind, level, text if text.startswith("<") else f"<p>{text}</p>")


def test_each_tier_in_turn():
    words = lambda n, w="w": " ".join(f"{w}{i}" for i in range(n))
    assert C.cascade([el("paragraph", "few words")], W, 10, 2) == [C.Part((), "few words", "whole")] and C.cascade([], W, 10, 2) == []
    two = [el("heading", "A", 1), el("paragraph", words(8)), el("heading", "B", 1), el("paragraph", words(8))]
    assert [(p.how, p.text.split()[0]) for p in C.cascade(two, W, 10, 2)] == [("whole", "A"), ("whole", "B")]
    one = [el("heading", "A", 1), el("paragraph", words(8)), el("paragraph", words(8)), el("heading", "sub", 2), el("paragraph", words(5))]
    assert [(p.headings, len(p.text.split())) for p in C.cascade(one, W, 12, 2)] == [(("A",), 8), (("A",), 8), (("A", "sub"), 5)]
    rows = "".join(f"<tr><td>{words(4)}</td></tr>" for _ in range(6))
    assert [p.how for p in C.cascade([el("table", f"<table>{rows}</table>")], W, 10, 2)] == ["structure"] * 3
    said = " ".join(f"{words(6)}." for _ in range(5))
    assert [(p.how, len(p.text.split())) for p in C.cascade([el("paragraph", said)], W, 13, 2)] == [("sentences", 12), ("sentences", 12), ("sentences", 6)]
    cut = C.cascade([el("paragraph", words(500))], W, 150, 20)
    assert [(p.how, p.text.split()[0], len(p.text.split())) for p in cut] == [("slices", "w0", 150), ("slices", "w130", 150), ("slices", "w260", 150), ("slices", "w390", 110)]
    with pytest.raises(ValueError):
        C.cascade([el("paragraph", words(500))], W, 110, 20)


def test_no_word_is_lost_and_every_part_fits():
    rng = random.Random(4)
    for _ in range(60):
        doc, n = [], 0
        for _ in range(rng.randrange(1, 30)):
            size = rng.choice([1, 3, 10, 40, 400])
            body = " ".join(f"x{n + i}" + rng.choice(["", "", ".", "?"]) for i in range(size))
            n += size
            kind = rng.choice(["heading", "paragraph", "paragraph"])
            doc.append(el(kind, body if kind == "paragraph" else " ".join(body.split()[:4]), rng.randrange(1, 4)))
        want = [w for e in doc for w in e.text().split()]
        parts = C.cascade(doc, W, 160, 20)
        assert all(W.count(p.whole()) <= 160 for p in parts)
        assert {w for p in parts for w in p.whole().split()} == set(want)
        firsts = [next(w for w in p.text.split()) for p in parts if p.text]
        assert [want.index(w) for w in firsts] == sorted(want.index(w) for w in firsts)


def test_tokenizers():
    import public_tokenizers

    bpe = Vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    text = "An unusual sentence, naïvely told."
    assert bpe.decode(bpe.encode(text)) == text and bpe.count(text) > W.count(text) == 5 and W.decode(W.encode(text)) == text
    assert Widest(W, bpe).count(text) == bpe.count(text) and isinstance(resolve(), Words) and resolve(bpe) is bpe
    set_default(bpe)
    assert resolve() is bpe
    set_default(None)
    for bad in (Widest, lambda: resolve(3)):
        with pytest.raises((TypeError, ValueError)):
            bad()
    cut = C.cascade([el("paragraph", " ".join(f"word{i}" for i in range(900)))], bpe, 300, 30)
    assert len(cut) > 5 and all(bpe.count(p.whole()) <= 300 for p in cut)


def test_on_a_table(spark):
    rows = [(1, 0, "heading", 1, "<h1>T</h1>"), (1, 1, "paragraph", None, "<p>" + "a " * 200 + "</p>"), (2, 0, "paragraph", None, None), (None, 0, "paragraph", None, "<p>b</p>")]
    df = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, pos int, element_type string, level int, html string, how int")
    got = sorted((str(r.doc_id), r.split_sequence, r.split_total, r.how, r.n_tokens) for r in C.split_cascade(df, 160, 20).collect())
    assert got == [("1", 1, 2, "slices", 160), ("1", 2, 2, "slices", 62), ("None", 1, 1, "whole", 1)]
    assert C.split_cascade(df.limit(0)).collect() == []
