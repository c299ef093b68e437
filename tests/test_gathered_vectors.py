"""Vectors by token of gathered rows: same rows as the shuffled grouping, no vector in an exchange."""

import random

from pyspark.sql import functions as F

from tessera.operators import embed as E
from tessera.plans import model_queries as MQ
from conftest import SF

ROWS = "article_id long, tokens array<string>, vecs array<array<float>>"


def _rows(spark, n=60):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        toks = [rng.choice("abcdefg") for _ in range(rng.randint(0, 40))]
        rows.append((rng.choice([None, *range(25)]), toks, [[rng.random(), -rng.random()] for _ in toks]))
    return spark.createDataFrame(rows, ROWS).repartition(5)


def _sorted(df):
    return sorted(map(str, df.collect()))


def test_gathered_fold_equals_the_grouping(spark, monkeypatch):
    rows = _rows(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        plain = E.vectors_by_token(E.token_vectors_long(rows))
        folded = E.vectors_by_token(E.token_vectors_long(E.gathered(rows, "article_id")), in_runs=True)
        assert folded.columns == plain.columns and _sorted(folded) == _sorted(plain)
        flat = [df.select("article_id", E.flatten_vectors(F.col("token_vectors")).alias("v")) for df in
                (E.token_vector_map(plain), E.token_vector_map(folded, in_runs=True))]
        assert _sorted(flat[0]) == _sorted(flat[1])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_no_vector_is_shuffled(spark):
    for query in (MQ.vectors_by_token, MQ.flatten_vectors):
        plan = query(spark, SF)._jdf.queryExecution().executedPlan().toString()
        below = plan[:plan.index("Exchange")]
        assert "Aggregate" not in below and plan.count("Exchange hashpartitioning(article_id") == 1
