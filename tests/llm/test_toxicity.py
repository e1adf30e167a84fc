import random
import unicodedata
import zlib
from itertools import combinations

import numpy as np
import pytest

from millrace.llm import toxicity as T

WORDS = ["thereon", "and", "singly", "oder", "reston", "hand", "ethin", "ander", "ionte", "thou", "enst", "reat", "lyan", "herth", "ouest", "blend", "tined", "esher", "wherin", "onst"]
BAD = ["idiot", "moron", "trash", "scumbag"]


def brute_kernel(a, b):
    def phi(w):
        out, w = {}, f"^{w}$"
        for i, j, k in combinations(range(len(w)), 3):
            if k - i < T.SPAN:
                out[w[i] + w[j] + w[k]] = out.get(w[i] + w[j] + w[k], 0) + T.DECAY ** (k - i + 1)
        return out

    p, q = phi(a), phi(b)
    dot = lambda x, y: sum(v * y.get(u, 0) for u, v in x.items())
    return dot(p, q) / np.sqrt(dot(p, p) * dot(q, q)) if p and q else 0.0


def made(n, seed, bad=BAD):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        w = ["".join(rng.choices(WORDS, k=rng.choice([1, 1, 2]))) for _ in range(rng.randrange(20, 120))]
        y = i % 4 == 0
        for _ in range(rng.choice([1, 2, 3]) * y):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((1000 + i, " ".join(w) + ".", int(y)))
    return rows


def test_kernel_matches_its_definition():
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdé", k=rng.randrange(1, 14))) for _ in range(80)] + ["aaa", "abcabcabc", "ab", "x" * 28]
    marks = ["abcde", "ababab", "cab", "édabca"]
    got = T.kernel(words, marks)
    assert np.allclose(got, [[brute_kernel(w, m) for m in marks] for w in words], atol=1e-5)
    rows, values = T.Features(marks).kernel(words, 3, 0.5)
    want = [i for i in range(len(words)) if got[i, :3].max() >= 0.5]
    assert sorted(rows.tolist()) == want and np.allclose(values[np.argsort(rows)], got[want], atol=1e-6)


def test_the_bound_rules_out_most_words_and_none_that_is_near():
    rng = random.Random(3)
    some = sorted({"".join(rng.choices(WORDS, k=2))[:11] for _ in range(600)})
    marks, words = some[:48], ["".join(rng.choices("aeinorstdhl", k=9)) for _ in range(4000)] + some
    features = T.Features(marks)
    value = T._places(11)[3].astype(float)
    codes = T._codes([w for w in words if len(w) == 9])
    kept, _ = features.raw(codes, len(marks), T.NEAR * np.sqrt((value**2).sum()))
    assert len(kept) < 0.2 * len(codes)
    full = T.kernel(words, marks)
    rows, values = features.kernel(words, len(marks), T.NEAR)
    want = np.flatnonzero(full.max(axis=1) >= T.NEAR)
    assert len(want) > 48 and sorted(rows.tolist()) == want.tolist() and np.allclose(values[np.argsort(rows)], full[want], atol=1e-6)


def test_words_by_their_definition():
    rng = random.Random(5)
    letters = list("abC_1.é-ÀÖ\n\xa0\x1c\x85İΣßªµﬁ中🙂²") + [" "] * 14
    for _ in range(4000):
        t = "".join(rng.choices(letters, k=rng.randrange(30)))
        plain = T._PUNCTUATION.sub("", unicodedata.normalize("NFKC", t).lower())
        words = T._SPACED.sub(lambda m: "".join(m[0].split()), plain).split()
        assert T.word_list(t) == words
        assert T.joined(words) == [a + b if len(a) < 4 and len(b) < 4 and len(a) + len(b) > 3 else "" for a, b in zip(words, words[1:])]
        assert T._owned(words)[1] == [u for w in words for u in T.forms(w)]


def test_words_and_their_forms():
    words = lambda t: set(T.word_list(t))
    assert {"idiot", "you"} <= words("You i.d.i.o.t") and "idiot" in words("i d  i o t!") and "idiot" in words("_id-iot_")
    assert words(None) == words(" . ") == set()
    assert T.forms("id1ot") == ["id1ot", "idiot"] and T.forms("ixdxixoxt") == ["ixdxixoxt", "idiot"] and T.forms("a") == []
    assert T.joined(["you", "mo", "ron", "there", "x"]) == ["youmo", "moron", "", ""]
    long = T.forms("q" * 500 + "z" * 60)
    assert all(len(w) <= 28 for w in long) and any("qz" in w for w in long)


def brute_score(text, model):
    """The definition: over all windows, the sum of what the distinct words and joined neighbours are worth."""

    def worth(word):
        ks = [[brute_kernel(u, m) for m in model.marks] for u in T.forms(word)]
        return max((max(0.0, float(np.array(k) ** T.POWER @ model.beta)) for k in ks if max(k[: len(model.toxic)]) >= T.NEAR), default=0.0)

    w = T.word_list(text)
    pairs = [*T.joined(w), ""]
    known = {x: worth(x) for x in {*w, *pairs}}
    sums = [sum(known[x] for x in {*w[i : i + T.WINDOW], *pairs[i : i + T.WINDOW]}) for i in range(len(w))]
    margin = model.bias + max(sums, default=0.0)
    return 1 / (1 + np.exp(-model.slope * (margin - model.middle)))


def test_scores_against_brute_force():
    rows = made(300, 6)
    model = T.fit([r[1] for r in rows], [r[2] for r in rows])
    texts = [r[1] for r in rows[:24]] + ["", None, "mo ron", "x" * 90 + " idiot", " ".join(f"{a} {b}" for a in WORDS[:9] for b in [*BAD, *WORDS]), "idiot " * 3 + "the " * 200 + "scumbag"]
    assert len(T.word_list(texts[-2])) > T.WINDOW
    assert np.allclose(T.score_texts(texts, model), [brute_score(t, model) for t in texts], atol=1e-4)


def test_held_out_accuracy_and_disguises():
    rows = made(1200, 2)
    model = T.fit([r[1] for r in rows if r[0] % 3], [r[2] for r in rows if r[0] % 3])
    rest = [r for r in rows if r[0] % 3 == 0]
    p = T.score_texts([r[1] for r in rest], model) >= T.REJECT
    y = np.array([r[2] for r in rest]) == 1
    assert (p == y).mean() > 0.98
    clean = " ".join(WORDS)
    assert (T.score_texts([f"{clean} {x} {clean}" for x in ("idiot", "mo ron", "ixdxixoxt", "idi-ot", "i d i o t", "iddiot", "idixot", "m.o.r.o.n", "mooron", "sc-umbag", "scumbbag")], model) >= T.REJECT).all()
    assert (T.score_texts([clean, "", None, "...", "1 2 3"], model) < T.REJECT).all()


def test_queries(spark):
    rows = made(800, 3)
    docs = [(i, t, "en", t) for i, t, _ in rows] + [(5, None, None, ""), (6, "", "en", "x"), (None, "some idiot", "en", "x"), (7, "thou and " * 60_000 + "moron", "en", "x")] + [(rows[0][0], rows[0][1], "en", "again")]
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (rows[1][0], None), (99999, 1)], "doc_id long, toxic int")
    got = T.toxicity(docs, labels).collect()
    assert len(got) == docs.count()
    want = {i: y for i, _, y in rows} | {5: 0, 6: 0, 7: 1, None: 1}
    assert np.mean([r.predicted == want[r.doc_id] for r in got]) > 0.98
    by = {r.doc_id: r for r in got}
    assert by[7].predicted == 1 and by[None].predicted == 1 and by[None].held_out is False and by[5].score == by[6].score
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got if r.doc_id is not None)
    none = T.toxicity(docs, labels.where("toxic = 0")).collect()
    assert {r.score for r in none} == {0.0} and len(none) == docs.count()
    assert T.toxicity(docs.limit(0), labels).collect() == []
    with pytest.raises(ValueError):
        T.score(docs, T.Model([], []), name="SCORE")
    texts, ys = T.labelled_sample(docs, labels, sample=20)
    assert len(texts) == 40 and sum(ys) == 20
