"""Generated statements: no masked value in what is served, and a poisoned policy is noticed."""

from __future__ import annotations

import pytest

from veilspark.catalogue import HOSTILE, REFUSALS, STATEMENTS, session
from veilspark.errors import PolicyRejection
from veilspark.operators import campaign, differential, reach, roles
from veilspark.plans import gates, lineage, safety

from .conftest import SF


@pytest.mark.parametrize(
    ("seed", "overlay"),
    [(1, {}), (2, {"lineage": "allow"}), (3, {"opaque": "mask"}), (4, {"opaque": "mask", "lineage": "allow"}), (5, {"posture": "hostile"})],
)
def test_no_canary_is_served(spark, seed, overlay):
    report = campaign.run(campaign.guard(spark, SF, **overlay), seed, 400)
    assert report.leaks == []
    assert report.statements == 400 and report.served >= 40


@pytest.mark.parametrize("rules", [{"x": {"mask": "none"}}, {"d": {"mask": "none"}}, {"n": {"mask": "none"}}])
def test_a_poisoned_policy_is_noticed(spark, rules):
    assert campaign.run(campaign.guard(spark, SF, rules), 6, 200).leaks


def test_statements_repeat_by_seed():
    a, b = campaign.Generator(3), campaign.Generator(3)
    assert [a.statement() for _ in range(50)] == [b.statement() for _ in range(50)]
    shapes = " ".join(campaign.Generator(9).statement() for _ in range(1)) + " ".join(campaign.Generator(s).statement() for s in range(400))
    for shape in ("UNPIVOT", "IDENTIFIER", "WITH", "LATERAL", "ROLLUP", "UNION", "TABLESAMPLE", "VALUES", "OVER", "SEMI JOIN", "date_trunc", "CAST("):
        assert shape in shapes


# -------------------------------------------------------------- differential
@pytest.mark.parametrize(("seed", "principal"), [(1, None), (2, "ann"), (3, "sam")])
def test_a_second_engine_agrees(spark, seed, principal):
    found = differential.compare(session(spark, SF), SF, seed, 35, principal)
    assert found.different == [] and found.served > 20 and found.rows > 250


def test_a_wrong_mask_is_noticed(spark, monkeypatch):
    from pyspark.sql import functions as F

    from veilspark.functions import masks

    monkeypatch.setattr(masks, "partial", lambda c, keep: F.concat(F.lit("*"), F.right(c, F.lit(keep))))
    assert differential.compare(session(spark, SF), SF, 4, 40).different


# --------------------------------------------------------------------- roles
def test_no_principal_gets_the_view_of_another(spark):
    people = roles.names_of(spark.read.parquet(f"{SF}/nation.parquet"), "n_nationkey")
    found = roles.campaign(spark, people, 200)
    assert found.mixed == [] and found.statements == 200 and found.generations > 10
    assert roles.campaign(spark, people, 60, session=roles.SharedPlans).mixed


# --------------------------------------------------------------------- reach
def test_decisions_of_the_policy_code_are_reached_both_ways(spark):
    guards = [session(spark, SF), session(spark, SF, posture="hostile"), session(spark, SF, lineage="allow", opaque="mask"), session(spark, SF, system_catalogs="allow", unique_keys={}, summaries="refuse")]
    texts = [t[0] for t in STATEMENTS.values()] + [t[1] for t in (*REFUSALS, *HOSTILE)] + list(reach.DIRECTED)
    with reach.Reach((gates, safety, lineage)) as r:
        found = reach.explore(r, guards, 5, len(texts), texts)
        for frame in (spark.read.parquet(f"{SF}/region.parquet"), spark.table("`demo.region`").crossJoin(spark.range(2)), spark.readStream.format("rate").load()):
            for g in guards:
                with pytest.raises(PolicyRejection) if g.policy.config.system_catalogs == "refuse" or frame.isStreaming else _whatever():
                    g.mask_frame(frame)
    table, missing = r.table(), r.missing()
    assert found.statements == len(texts) and len(table) > 200
    assert len(missing) < 0.12 * len(table), missing


def _whatever():
    from contextlib import suppress

    return suppress(PolicyRejection)


def test_exploring_finds_what_generating_alone_does_not_repeat(spark):
    g = campaign.guard(spark, SF)
    with reach.Reach((safety,)) as r:
        found = reach.explore(r, [g], 7, 30)
    assert found.statements == 30 and 2 < len(found.found) < 30 and sum(n for _, n in r.table()) > 200


def test_leaks_shrink():
    text = "WITH w AS (SELECT id, x, y FROM fz.t WHERE id > 3) SELECT upper(y) AS q1, x AS q2, count(*) OVER () AS q3 FROM w ORDER BY 1 LIMIT 9"
    assert len(reach.shrink(text, lambda t: "upper" in t and "y" in t)) < 12
