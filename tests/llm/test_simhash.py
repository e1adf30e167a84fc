import random

import numpy as np
import xxhash

from millrace.llm.simhash import fingerprint_links, near_duplicates, shingle_hashes, simhash, trie_links

SCHEMA = "doc_id long, text string, fp string, root long"


def slow_simhash(text):
    raw = (text or "").encode()
    raw = bytes(c + 32 if 65 <= c <= 90 else c for c in raw)
    words, now = [], b""
    for c in raw:
        if c == 32 or 9 <= c <= 13:
            words, now = words + [now] * bool(now), b""
        else:
            now += bytes([c])
    words += [now] * bool(now)
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows):
    fps = [slow_simhash(r[1]) for r in rows]
    group = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (fps[i] ^ fps[j]).bit_count() <= 2 and group[i] != group[j]:
                    group[i] = group[j] = min(group[i], group[j])
                    changed = True
    low = {}
    for r, g in zip(rows, group):
        if r[0] is not None:
            low[g] = min(low.get(g, r[0]), r[0])
    return sorted(((r[0], f"{f:016x}", low.get(g)) for r, f, g in zip(rows, fps, group)), key=str)


def test_fingerprint_matches_its_definition():
    for t in ["", None, " \t\n", "One", "a B", "a b c", "É É É é ß", "x" * 5000 + " y z", "a\x0bb\x0cc\xa0d e", "the same " * 3000]:
        assert simhash(t) == slow_simhash(t)
    assert len(shingle_hashes("a b c d")) == 2


def test_trie_join_finds_every_pair_within_the_budget():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    x = np.unique(np.concatenate([x, x[:200] ^ np.uint64(1 << 40), x[:100] ^ np.uint64(5), x[:100] ^ np.uint64(7 << 20), np.arange(40, dtype=np.uint64)]))
    apart = np.bitwise_count(x[:, None] ^ x[None, :])
    for budget in (0, 1, 2, 4):
        assert {*zip(*map(np.ndarray.tolist, trie_links(x, None, budget)))} == {*zip(*map(np.ndarray.tolist, np.nonzero(np.triu(apart <= budget, 1))))}
        assert {*zip(*map(np.ndarray.tolist, trie_links(x[:99], x[99:], budget)))} == {*zip(*map(np.ndarray.tolist, np.nonzero(apart[:99, 99:] <= budget)))}


def test_links_across_many_small_blocks(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 1 << 63, 300, dtype=np.uint64) * np.uint64(2)
    x = np.unique(np.concatenate([x, x ^ np.uint64(3 << 60), x[:99] ^ np.uint64(1), np.arange(60, dtype=np.uint64)]))
    fps = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    got = {frozenset((r.u, r.v)) for r in fingerprint_links(fps, len(x), 2, block=16).collect()}
    want = np.nonzero(np.triu(np.bitwise_count(x[:, None] ^ x[None, :]) <= 2, 1))
    s = x.view(np.int64)
    assert got == {frozenset((int(s[i]), int(s[j]))) for i, j in zip(*want)}


def test_documents_against_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    rows = [(1, None), (2, ""), (9, "  "), (3, "One two"), (4, "one  TWO"), (5, "one"), (None, "one"), (None, "quite alone here"), (7, "x " * 4000)]
    for i in range(40):
        w = [rng.choice(vocab) for _ in range(rng.choice([30, 200, 800]))]
        rows.append((100 + i, " ".join(w)))
        for j in range(i % 4):
            w[rng.randrange(len(w))] = "edit"
            rows.append((1000 + 10 * i + j, " ".join(w)))
    rows += rows[20:40]  # repeated rows
    df = spark.createDataFrame([(a, b, "clash", 1) for a, b in rows], SCHEMA)
    got = sorted(map(tuple, near_duplicates(df).collect()), key=str)
    assert got == brute(rows)
    assert len({r[2] for r in got}) < len(got)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
