"""Campaigns at size: rows of what is served stay in tasks, the driver gets figures."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from veilspark.catalogue import session
from veilspark.operators import campaign, differential, roles
from veilspark.operators.results import MaskedFrame

from .conftest import SF


@pytest.fixture
def collected(monkeypatch):
    """Numbers of rows that the driver was given of masked results."""
    seen, collect = [], MaskedFrame.collect

    def counting(self):
        rows = collect(self)
        seen.append(len(rows))
        return rows

    monkeypatch.setattr(MaskedFrame, "collect", counting)
    return seen


def test_a_comparison_gives_the_driver_fingerprints_only(spark, collected):
    found = differential.compare(session(spark, SF), SF, 1, 10)
    assert found.different == [] and found.rows > 100
    assert sum(collected) <= 2 * found.served


def test_views_of_roles_are_held_against_fingerprints(spark, collected):
    names = roles.names_of(spark.range(300), "id")
    for role in roles.MASKS:
        for g in (0, 7, 22):
            assert all(r.e == roles.expected(r.name, role, g) for r in names.limit(5).select("name", roles.expected_column(F.col("name"), role, g).alias("e")).collect())
    found = roles.campaign(spark, names, 30)
    assert found.mixed == [] and found.statements == 30
    assert max(collected) <= 3


def test_canaries_are_searched_where_they_stand(spark, monkeypatch):
    g = campaign.guard(spark, SF)
    poisoned = campaign.guard(spark, SF, {"n": {"mask": "none"}})
    monkeypatch.setattr(MaskedFrame, "collect", lambda self: pytest.fail("rows reached the driver"))
    assert campaign._canaries([g.sql("SELECT id, n FROM fz.t"), g.sql("SELECT x FROM fz.u")]) is False
    assert campaign._canaries([g.sql("SELECT id FROM fz.t"), poisoned.sql("SELECT n FROM fz.t")]) is True
    assert campaign._canaries([g.sql("SELECT id FROM fz.t WHERE id < 0")]) is False


def test_a_subquery_over_an_outer_value_makes_no_pairs(spark, tmp_path):
    spark.range(600).selectExpr("id AS s_suppkey", "concat('s', id) AS s_name").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(25).selectExpr("id AS n_nationkey", "concat('n', id) AS n_name").write.parquet(f"{tmp_path}/nation.parquet")
    g = campaign.guard(spark, str(tmp_path))
    where = next(w for s in range(200) if " IN (SELECT" in (w := campaign.Generator(s).where([("q3", "number")])))
    frame = g.sql(f"SELECT q1 FROM fz.t AS q0(q1, q2, q3, q4, q5, q6, q7){where}")
    assert sorted(r.q1 for r in frame.collect()) == list(range(600))
    assert 600 <= _joined(frame._jdf.queryExecution().executedPlan()) <= 1200
    own = {w for s in range(200) if " IN (SELECT" in (w := campaign.Generator(s).where([("m", "number")]))}
    assert own == {" WHERE m IN (SELECT m FROM fz.t)"}


def _joined(node) -> int:
    """Rows that the joins of an executed plan made."""
    if node.nodeName() == "AdaptiveSparkPlan":
        return _joined(node.executedPlan())
    below, rows = node.children(), node.metrics().get("numOutputRows")
    inner = [node.plan()] if "QueryStage" in node.nodeName() else [below.apply(i) for i in range(below.size())]
    own = rows.get().value() if "Join" in node.nodeName() or "Cartesian" in node.nodeName() else 0
    return own + sum(map(_joined, inner))
