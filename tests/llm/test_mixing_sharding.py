import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import mixing, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tokens int"


def rows():
    out = [(i, " ".join(["word"] * (i % 40 + 1)) + (" | cell" if i % 9 == 0 else "") + ("\nReleased under the MIT License." if i % 13 == 0 else ""), ("en", "de", "fr", "es", "xx")[i % 5], f"src{0 if i % 3 == 0 else i % 23}", 1, 1) for i in range(3000)]
    return out + [(None, None, None, None, None, None), (5000, "", "en", "src1", 0, 0), (5001, " \t\x0b\n", "en", "src1", 0, 0), out[5], out[5]]


def duck(sql, data):
    import pandas as pd

    con = duckdb.connect()
    documents = pd.DataFrame(data, columns=["doc_id", "text", "lang", "source", "n_chars", "x"])
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    con.register("documents", documents)
    return con.sql(sql).fetchall()


def test_rake_meets_its_marginals_below_one():
    rng = np.random.default_rng(0)
    cells = rng.integers(300, 1000, (4, 3, 2)).astype(float)
    targets = [np.array(w) for w in ([0.4, 0.3, 0.2, 0.1], [0.5, 0.3, 0.2], [0.7, 0.3])]
    held = [cells.sum(axis=tuple(i for i in range(3) if i != axis)) for axis in range(3)]
    total = mixing.size(cells, targets)
    assert np.isclose(total, mixing.SLACK * min((h / t).min() for h, t in zip(held, targets)))
    for n, off in ((total, 0.01), (0.6 * total, 1e-6)):
        kept = cells * np.minimum(1, mixing.rake(cells, [mixing.wants(h, t, n) for h, t in zip(held, targets)]))
        for axis, t in enumerate(targets):
            assert np.allclose(kept.sum(axis=tuple(i for i in range(3) if i != axis)) / kept.sum(), t, atol=off)


def test_wants_and_size():
    held = np.array([10.0, 0, 40, 50])
    assert np.allclose(mixing.wants(held, np.array([0.5, 0.2, 0.2, 0.1]), 40), [10, 0, 20, 10])
    assert np.allclose(mixing.wants(held, np.array([0.1, 0.0, 0.4, 0.5]), 60), [6, 0, 24, 30])
    assert np.allclose(mixing.wants(held, np.array([0.9, 0.0, 0.1, 0.0]), 20), [10, 0, 10, 0])
    cells = np.array([[10.0], [990.0]])
    targets = [np.array([0.5, 0.5]), np.array([1.0])]
    assert np.isclose(mixing.size(cells, targets, least=0.001), 18) and np.isclose(mixing.size(cells, targets), 50)
    assert np.isclose(mixing.size(np.array([[500.0], [500.0]]), targets), 800)
    assert mixing.calibrated({("src0", "en", "prose"): 5}, mixing.TARGETS) == {("src0", "en", "prose"): 0.8} and mixing.calibrated({}, mixing.TARGETS) == {}


def test_mix_matches_sql_and_reaches_its_targets(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).drop("tokens")
    marked = mixing.mix_marks(df).select("doc_id", "tokens", "cell_source", "cell_lang", "cell_topic", "probability", "sampled").collect()
    assert sorted(map(tuple, marked), key=str) == sorted(duck(mixing.sql(), data), key=str)
    clashing = spark.createDataFrame(data, SCHEMA).withColumn("__tokens", F.lit(1)).withColumn("__SOURCE", F.lit("x"))
    kept = mixing.mix(clashing)
    assert kept.columns == clashing.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(r.doc_id) for r in marked if r.sampled)
    with pytest.raises(ValueError):
        mixing.mix_marks(clashing)
    got = mixing.shares(df).collect()
    held = {(r.marginal, r.value): r for r in got if r.held > 0}
    for marginal in ("source", "lang", "topic"):
        reachable = sum(r.target for (m, _), r in held.items() if m == marginal)
        assert all(abs(r.expected - r.target / reachable) < 0.01 for (m, _), r in held.items() if m == marginal)
    drawn = {}
    for r in marked:
        drawn[r.cell_source] = drawn.get(r.cell_source, 0) + r.tokens * r.sampled
    assert abs(drawn["src0"] / sum(drawn.values()) - held["source", "src0"].expected) < 0.05
    assert mixing.mix(df.limit(0)).collect() == [] and {r.expected for r in mixing.shares(df.limit(0)).collect()} == {0.0}


def test_table_is_filled_by_turns():
    names = [f"s{i}" for i in range(7)]
    table = sharding.lookup(names, 101)
    counts = np.bincount(table)
    assert counts.max() - counts.min() <= 1 and len(counts) == 7
    marks = [int.from_bytes(sharding.hashlib.md5(s.encode()).digest(), "big") for s in names]
    orders = [[(m % 101 + j * ((m >> 64) % 100 + 1)) % 101 for j in range(101)] for m in marks]
    slow, turn = {}, 0
    while len(slow) < 101:
        i = turn % 7
        slow[next(p for p in orders[i] if p not in slow)] = i
        turn += 1
    assert table == [slow[p] for p in range(101)]
    fewer = sharding.lookup(names[:-1], 101)
    assert sum(a != b for a, b in zip(table, fewer) if a != 6) < 30
    for bad in (([], 101), (["a", "a"], 101), (["a"], 100)):
        with pytest.raises(ValueError):
            sharding.lookup(*bad)


def test_placement_matches_sql(spark):
    data = rows()
    df = sharding.place(spark.createDataFrame(data, SCHEMA))
    got = {(r.doc_id, r.shard) for r in df.collect()}
    assert got == {(r[0], r[2]) for r in duck(sharding.sql(), data)}
    assert max(np.bincount([s for _, s in got])) < 3 * 3000 / 64
