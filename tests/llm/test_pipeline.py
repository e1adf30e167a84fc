import random

import corpus_pipeline as P
from test_jaccard import brute
from test_toxicity import made

from millrace.llm import mixing, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def tables(folder, spark):
    rng = random.Random(9)
    docs = [(i, t, rng.choice(["en", "de", "fr", "es"]), f"src{rng.choice([0, 0, rng.randrange(20)])}", len(t)) for i, t, _ in made(500, 4)]
    docs += [(5000 + i, d[1].replace(".", " ,"), *d[2:]) for i, d in enumerate(docs[1:60])] + [(6000 + i, *docs[5][1:]) for i in range(50)]
    docs += [(None, None, None, None, None), (7000, "", "en", "src1", 0), (7001, None, "xx", "srcx", 0), docs[9], docs[9]]
    labels = [(i, 1, y) for i, _, y in made(500, 4)]
    spark.createDataFrame(docs, SCHEMA).repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs


def test_stages_against_brute_force(spark, tmp_path):
    given = tables(tmp_path, spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    rows = {}
    for name, stage in P.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        rows[name] = [tuple(r) for r in docs.collect()]
        if name != "packing":
            assert docs.columns == COLUMNS
    first, second, third, last = (rows[n] for n, _ in P.STAGES)
    key = lambda r: tuple(map(str, r))
    source = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = toxicity.fit(*toxicity.labelled_sample(source, spark.read.parquet(f"{tmp_path}/labels.parquet")))
    assert sorted(first, key=key) == sorted((r for r in given if toxicity.score_texts([r[1]], model)[0] < toxicity.REJECT), key=key)
    assert 0 < len(given) - len(first) < 0.4 * len(given)
    ids = {c for i, c in brute([r[:2] for r in first]) if i is not None}
    assert sorted(str(r[0]) for r in second) == sorted(map(str, [*ids, *(r[0] for r in first if r[0] is None)]))
    assert all(r in first for r in second)
    marks = {str(r.doc_id): r.sampled for r in mixing.mix_marks(spark.createDataFrame(second, SCHEMA)).collect()}
    assert sorted(third, key=key) == sorted((r for r in second if marks[str(r[0])]), key=key) and len(third) > 20
    assert {r[0] for r in last} == {r[0] for r in third}
    ran = P.run(spark, str(tmp_path))
    assert sorted(r[:5] for r in map(tuple, ran.collect())) == sorted(r[:5] for r in last) if None not in {r[0] for r in last} else ran.count() == len(last)


def test_stages_pass_clashing_columns_through(spark, tmp_path):
    tables(tmp_path, spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    clashing = docs.selectExpr("*", *(f"'{n}' AS {n}" for n in ("toxicity", "__toxicity", "__tokens", "__source", "__id", "__hash", "text_hash", "stays", "n", "r", "tokens", "shard", "y", "fp", "component_id", "length", "sequence_id")))
    for name, stage in P.STAGES:
        want = sorted(str(r.doc_id) for r in stage(spark, docs, str(tmp_path)).collect())
        got = stage(spark, clashing, str(tmp_path))
        assert sorted(str(r.doc_id) for r in got.collect()) == want
        if name != "packing":
            assert got.columns == clashing.columns and got.select("__hash", "n", "y").distinct().count() == 1


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).collect() == []
