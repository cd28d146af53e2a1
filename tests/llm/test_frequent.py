"""The most frequent keys without a sort."""

import pytest

from palisade.llm.frequent import most_frequent


def test_a_level_of_equal_counts_is_taken_in_part(spark):
    counts = spark.range(300_000).selectExpr("id AS token", "5L AS c")
    found = most_frequent(counts, "c", 200_000)
    n = found.count()
    assert 199_800 <= n <= 200_000 and found.distinct().count() == n
    assert most_frequent(counts, "c", 0).count() == 0


@pytest.mark.parametrize("most", [1, 40, 500, 10_000])
def test_the_greatest_counts_come_first(spark, most):
    counts = spark.range(1, 2001).selectExpr("id AS token", "id AS c")
    found = sorted(r["c"] for r in most_frequent(counts, "c", most).collect())
    least = 2000 - min(most, 2000) + 1
    assert len(found) <= most and (len(found) == 2000 if most >= 2000 else len(found) >= 0.98 * most - 1)
    assert not found or found[0] >= least * 0.9
