"""Rules tested on findings where they stand."""

from polyglint.operators import rules as R

RULES = [
    ("p", 1, "ignore", "a.*", None), ("p", 2, "ignore_missing", "b.*", "de"), ("p", 3, "ignore_missing", "b.*", "fr"), ("p", 4, "ignore_unused", "b.*", None),
    ("p", 5, "ignore_eq_base", "*.z", "all"), ("q", 6, "ignore", "a.*", None), ("p", 7, "ignore", None, None),
]
FINDINGS = [("p", "missing", "de", "a.x"), ("p", "missing", "de", "b.x"), ("p", "missing", "de", "b.x"), ("p", "eq_base", "fr", "c.z"), ("q", "unused", "de", "b.x")]


def both(spark):
    return (
        spark.createDataFrame(RULES, "project string, rule_id bigint, setting string, pattern string, locale_group string"),
        spark.createDataFrame(FINDINGS, "project string, kind string, locale string, key string"),
    )


def test_few_rules_and_many_agree(spark, monkeypatch):
    rules, findings = both(spark)
    few = sorted(r["rule_id"] for r in R.stale_rules(rules, findings).collect())
    monkeypatch.setattr(R, "LITERAL_RULES", 0)
    many = sorted(r["rule_id"] for r in R.stale_rules(rules, findings).collect())
    assert few == many == [3, 4, 6, 7]


def test_findings_meet_few_rules_without_a_join(spark):
    rules, findings = both(spark)
    plan = R.stale_rules(rules, findings)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "p_anchor" not in plan
