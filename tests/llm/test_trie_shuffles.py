"""The trie join deals its rows out once, also where Spark broadcasts nothing by itself."""

import numpy as np

from touchline.llm import simhash


def test_rows_of_the_trie_join_are_shuffled_once(spark):
    x = np.random.default_rng(3).integers(-(1 << 63), (1 << 63) - 1, (300, 9), dtype=np.int64).tolist()
    x += [[r[0] ^ 1, *r[1:]] for r in x[:20]]  # other nodes of equal words
    df = spark.createDataFrame([(r[0], r[1:5], r[5:]) for r in x], "node long, far array<long>, words array<long>")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = simhash.links(df, simhash.similar_turns(len(x)), simhash.slack(256))
        plan = found._jdf.queryExecution().executedPlan().toString()
        edges = {tuple(sorted((r.u, r.v))) for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert edges == {tuple(sorted((r[0], r[0] ^ 1))) for r in x[:20]}
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 1
