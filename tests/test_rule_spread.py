"""Texts stay where they are when they meet a few rules."""

from fieldmarch.operators import rules


def test_texts_are_not_dealt_by_rule_block(spark):
    texts = spark.createDataFrame([(i, f"word {i}") for i in range(20)], "id int, text string")
    table = spark.createDataFrame([(i, [f"{i}$"], []) for i in range(3)], "rule_id int, patterns array<string>, excludes array<string>")
    out = rules.match_table(texts, table, "text")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    assert sorted((r.rule_id, r.id) for r in out.collect()) == [(0, 0), (0, 10), (1, 1), (1, 11), (2, 2), (2, 12)]
