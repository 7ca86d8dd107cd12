"""Texts that share words with claims are found without being shuffled, and the shuffled form finds the same."""

from casewright import catalog
from casewright.operators import claims


def test_texts_of_denials_are_not_shuffled(spark, sf):
    plan = catalog.denied_claims(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_many_words_meet_by_a_shuffle(spark):
    left = spark.createDataFrame([(f"word{k} word{k + 1} word{k * 2} rare{k}",) for k in range(12)], "t string")
    right = spark.createDataFrame([(" ".join(f"word{j}" for j in range(k, k + 9)) + f" rare{k}",) for k in range(15)], "u string")
    found = lambda most: sorted(tuple(r) for r in claims._sharing(left, right, "t", "u", 0.5, most).collect())
    assert found(0) == found(10**6) and len(found(0)) > 12
