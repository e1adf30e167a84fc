import random

import corpus_pipeline as P
import numpy as np

from millrace.llm import jaccard
from millrace.llm.jaccard import first_copies, near_copies

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets, group = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if group[i] != group[j] and 5 * len(a & b) >= 4 * len(a | b):
                group = [min(group[i], group[j]) if g in (group[i], group[j]) else g for g in group]
    low = {}
    for (d, _), g in zip(rows, group):
        if d is not None:
            low[g] = min(low.get(g, d), d)
    return sorted(((d, low.get(g)) for (d, _), g in zip(rows, group)), key=str)


def edited():
    """Texts with copies in which one to eight words are replaced: similarities from 0.5 to 0.97."""
    rng = random.Random(5)
    rows = []
    for i in range(60):
        w = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([3, 80, 150]))]
        rows.append((i * 10, " ".join(w)))
        for k in range(4):
            v = list(w)
            for at in rng.sample(range(len(v)), min(len(v), rng.randrange(1, 9))):
                v[at] = f"z{rng.randrange(5000)}"
            rows.append((i * 10 + 1 + k, " ".join(v)))
    # A chain whose ends aren't similar, and rows with nothing in them.
    w = [f"c{i}" for i in range(100)]
    rows += [(2000 - k, " ".join([*w[k * 8 :], *(f"d{i}" for i in range(k * 8))])) for k in range(6)]
    return [*rows, (3000, None), (3001, ""), (3002, " \n"), (None, rows[0][1]), (None, None), (0, rows[0][1]), (3003, "alone"), (3004, "ALONE")]


def test_components_against_all_pairs(spark):
    rows = edited()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows)
    got = near_copies(df).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == want
    assert all(r.stays == (r.doc_id is not None and r.doc_id == r.component_id) for r in got)
    assert 60 < len({c for _, c in want}) < len(rows) - 40
    assert near_copies(df.limit(0)).collect() == []


def test_stage_drops_edited_copies(spark, tmp_path):
    rows = edited()
    docs = spark.createDataFrame([(d, t, "en", "src", 1) for d, t in rows], SCHEMA)
    kept = dict(P.STAGES)["near duplicates"](spark, docs, str(tmp_path))
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["None"] * 2 + [str(c) for c in {c for d, c in brute(rows) if d is not None}])


def test_repeated_ids_are_decided_by_their_texts(spark):
    one, two, far = (" ".join(f"{p}{i}" for i in range(40)) for p in "abc")
    rows = [(1, one, "x"), (1, two, "x"), (1, two, "w"), (2, one, "x"), (3, two, "x"), (4, far, "x"), (4, far, "x"), (None, far, "x"), (None, far, "x")]
    docs = spark.createDataFrame([(i, t, c, 1, 2) for i, t, c in rows], "doc_id long, text string, __id string, __hash int, stays int").repartition(3)
    got = first_copies(docs)
    assert got.columns == docs.columns
    # Of id 1 each text stays, for each is the first of its own component; equal rows stay once.
    assert sorted((str(r.doc_id), r.text, r["__id"]) for r in got.collect()) == sorted([("1", one, "x"), ("1", two, "w"), ("4", far, "x"), ("None", far, "x"), ("None", far, "x")])
    assert first_copies(docs.limit(0)).collect() == []


def test_candidates_are_the_pairs_that_a_fingerprint_part_links(spark):
    rng = np.random.default_rng(8)
    fps = [rng.integers(0, 256, jaccard.PARTS * jaccard.PART_BITS // 8, dtype=np.uint8) for _ in range(150)]
    # Copies with bits turned, among them many that share whole parts.
    fps += [f ^ np.packbits(rng.random(8 * len(f)) < rng.choice([0.01, 0.1, 0.16, 0.25])) for f in fps[:100]] + [fps[0] ^ np.packbits(rng.random(8 * len(f)) < 0.02) for f in fps[:40]]
    n = [int(x) for x in rng.choice([100, 110, 140], len(fps))]
    bits = np.unpackbits(np.array(fps), axis=1)
    want = set()
    for i in range(1, len(fps)):
        apart = bits[:i] ^ bits[i]
        parts, words = apart.reshape(i, jaccard.PARTS, -1).sum(axis=2), apart.reshape(i, -1, 64).sum(axis=2)
        first = np.arange(jaccard.PARTS) * jaccard.PART_BITS // 64 + 2
        check = words[:, first % words.shape[1]] + words[:, (first + 1) % words.shape[1]]
        linked = ((parts <= jaccard.BUDGET) & (check <= jaccard.CHECK_MOST)).any(axis=1)
        want |= {(i, j) for j in np.flatnonzero(linked) if 5 * min(n[i], n[j]) >= 4 * max(n[i], n[j])}
    nodes = spark.createDataFrame([(i, n[i], f.tobytes()) for i, f in enumerate(fps)], "node long, n long, fp binary").repartition(3)
    for block in (jaccard.BLOCK, 40):
        got = jaccard.candidates(nodes, len(fps), block=block).collect()
        assert len(got) == len(want) and {(r.u, r.v) for r in got} == want
    assert len(want) > 500 and jaccard.candidates(nodes.limit(0), 0).collect() == []
