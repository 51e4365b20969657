"""The corpus pipeline against a brute-force version of each stage's decision, and the registered SQL."""

from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cragline.llm import queries

from .test_operators import EDGE, LABELS, corpus, docs, labelled, reach, shingles

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("sf")
    rows, labels = labelled(n=160)
    rows = [(5000 + i, *r) for i, *r in rows]
    rows[1] = (5001, rows[1][1] + " token = 'A1b2C3d4E5f6' end", *rows[1][2:])
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    plain = corpus(3, 30)[:90]
    rows += plain + [(9001, f"some words before {item} and some words after it all", "en", "s", 0)]
    docs(spark, rows, clash=False).write.parquet(str(root / "documents.parquet"))
    spark.createDataFrame([(5000 + i, q, t) for i, q, t in labels], LABELS).write.parquet(str(root / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(root / "benchmark.parquet"))
    return str(root)


def test_stages_take_effect(spark, tables):
    d = spark.read.parquet(f"{tables}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    kept = [d]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(stage(spark, kept[-1], tables).cache())
    for k in kept[:-1]:
        assert k.columns == d.columns and k.dtypes == d.dtypes
    ids = [{r["doc_id"] for r in k.select("doc_id").collect()} for k in kept]
    text = {r["doc_id"]: r["text"] for r in d.collect()}
    good, one, clean, safe, packed = ids[1:]
    assert names[0] == "quality" and not {5000 + i for i in range(0, 160, 4)} & good and {5000 + i for i in range(160) if i % 4} <= good
    sets = {i: shingles(text[i]) for i in good}
    order = sorted(good)
    links = [(a, b) for k, a in enumerate(order) for b in order[:k] if len(sets[a] & sets[b]) * 1.8 >= 0.8 * (len(sets[a]) + len(sets[b])) - 1e-9]
    assert one == {i for i, r in reach(order, links).items() if i == r}
    assert clean == one - {9001} and safe == clean == packed
    redacted = {r["doc_id"]: r for r in kept[4].collect()}
    assert redacted[5001]["text"] == text[5001].replace("token = 'A1b2C3d4E5f6", "[SECRET]") and redacted[5001]["n_chars"] == len(redacted[5001]["text"])
    assert all(redacted[i]["text"] == text[i] for i in safe - {5001})


def test_run_equals_the_stages(spark, tables):
    got = corpus_pipeline.run(spark, tables)
    d = spark.read.parquet(f"{tables}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        d = stage(spark, d, tables)
    key = lambda df: sorted(map(tuple, df.select("doc_id", "piece", "length").collect()))
    assert key(got) == key(d) and queries.pipeline(spark, tables).count() == got.count()


def test_stages_on_nulls_and_nothing(spark, tables):
    more = [(None, "password = hunter2222 and more", "en", "a", 5), (None, None, None, None, None), (3, "token: abcdefgh other words", "en", "b", 5)]
    for rows in (EDGE + more, []):
        d = docs(spark, rows, clash=False).withColumns({c: F.lit(1) for c in ("gone", "hit", "marks", "bad", "r1", "k1", "cuts")})
        good = {(r["doc_id"], r["text"]) for r in corpus_pipeline.quality(spark, d, tables).collect()}
        for _, stage in corpus_pipeline.STAGES[:-1]:
            d = stage(spark, d, tables).cache()
        got = [(r["doc_id"], r["text"]) for r in d.collect()]
        # of what quality keeps: every row without words, one of each set of words (the named, smallest id), secrets gone
        want, seen = [], set()
        for i, t in sorted(((r[0], r[1]) for r in rows if (r[0], r[1]) in good), key=lambda x: (x[0] is None, x[0] or 0)):
            words = tuple((t or "").lower().split())
            if not words or words not in seen:
                want.append((i, {"password = hunter2222 and more": "[SECRET] and more", "token: abcdefgh other words": "[SECRET] other words"}.get(t, t)))
            seen.add(words)
        assert sorted(map(repr, got)) == sorted(map(repr, want))
        packed = corpus_pipeline.packed(spark, d, tables).collect()
        assert {r["doc_id"] for r in packed} == {i for i, _ in got} and sum(r["piece"] == 0 for r in packed) == len(got)


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, SF).toPandas()[list(want.columns)]
    plain = lambda v: None if v is None or v is pd.NA or v != v else round(float(v), 9) if isinstance(v, (bool, int, float, np.number, np.bool_)) else v
    a, b = (sorted(tuple(map(repr, map(plain, r))) for r in x.astype(object).itertuples(index=False)) for x in (got, want))
    assert len(a) == len(b) and a == b
