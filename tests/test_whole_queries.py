"""Queries on tables of the tests' own, where the driver's tables do not show the case."""

from claimloom.operators import views
from claimloom.queries import QUERIES


def test_candidates_are_all_given(spark, tmp_path):
    spark.range(1100).selectExpr("concat('Brand#1', id) AS p_brand").write.parquet(str(tmp_path / "part.parquet"))
    assert QUERIES["candidate_casefold_prefix"](spark, str(tmp_path)).count() == 1100


def test_entity_find_pivot_runs_the_operator(spark, sf, monkeypatch):
    seen = []
    find = views.find
    monkeypatch.setattr(views, "find", lambda *a, **filters: seen.append(filters) or find(*a, **filters))
    got = QUERIES["entity_find_pivot"](spark, sf).collect()
    assert seen == [{"orders": 10}] and len(got) == 1 and 10 in got[0]["orders"] and got[0]["orders"] == sorted(got[0]["orders"])
