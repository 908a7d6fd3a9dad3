"""The log of view C meets every branch of rules, seeds, reference labels and protection, at both sizes."""

import duckdb
import pytest

from tidelog import catalog, fixtures
from tidelog.operators import analytics, rules


@pytest.fixture(scope="module", params=["sf0.01", "sf0.1"])
def result(request):
    """Distinct rows of a query's SQL at that size."""
    con = duckdb.connect()
    for t in fixtures.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/{request.param}/{t}.parquet'")
    con.execute(f"CREATE TABLE log_c AS WITH {fixtures.LOG_C} SELECT * FROM log")
    sql = {name: query.replace(fixtures.LOG_C, "log AS (SELECT * FROM log_c)") for name, query in catalog.oracle_sql().items()}
    return lambda name, columns: set(con.execute(f"SELECT DISTINCT {columns} FROM ({sql[name]})").fetchall())


def test_every_class_occurs(result):
    assert result("class_rules", "behavior_type, automation_category") == {("organic", None), ("automated", "bot"), ("automated", "legitimate_automation")}
    assert result("class_rules", "is_bot, is_hub, is_organic") == {("true", "false", "false"), ("false", "true", "false"), ("false", "false", "true")}
    assert result("flagship_labels", "label") == {("bot",), ("hub",), ("organic",)}
    assert result("annotate_join", "is_bot, is_hub, is_organic") == result("annotate_legacy", "is_bot, is_hub, is_organic") == result("class_rules", "is_bot, is_hub, is_organic")


def test_every_reference_label_occurs(result):
    texts = {t for (t,) in result("class_ground_truth", "ground_truth_criteria")}
    assert len(texts) == 10 and "users 10-200 dpu>=200 total>=100000 working>=0.2" in texts
    assert {x for (x,) in result("class_ground_truth", "ground_truth_label")} == {"bot", "hub", "organic", "uncertain"}


def test_every_tier_of_seeds_occurs(result):
    assert {x for (x,) in result("class_seeds", "organic_seed")} == {None, 0.4, 0.7, 1.0}
    assert {x for (x,) in result("class_seeds", "bot_seed")} == {None, 0.7, 0.9, 0.95}
    assert {x for (x,) in result("class_seeds", "hub_seed")} == {None, 0.8, 0.95}


def test_protection_keeps_and_refuses(result):
    found = result("class_hub_protection", "is_protected_hub, user_category")
    assert found >= {("true", "normal"), ("true", "download_hub"), ("false", "bot"), ("false", "download_hub"), ("false", "normal")}


def test_regions_kinds_and_bins_occur(result):
    assert {r for (r,) in result("ana_by_region", "region")} == {*analytics.REGIONS, "Other"}
    assert {k for (k,) in result("ana_file_types", "kind")} == {"raw", "peaks", "results", "other"}
    assert len(result("ana_files_hist", "bin")) >= 3
    assert len(result("ana_by_country", "country")) >= 20


def test_cleaning_and_evaluation_have_something_to_decide(result):
    ((every, left),) = result("ana_before_after", 'sum("before"), sum("after")')
    assert 0 < left < every
    assert len(result("eval_confusion", "truth, predicted")) > 3
    ((a, b, chi2, p),) = result("eval_mcnemar", "only_a, only_b, chi2, p_value")
    assert a and b and chi2 > 0 and 0 <= p < 1
    assert len(result("stat_top_locations", "geo_location")) == 5
    assert {x for (x,) in result("stat_yearly_by_label", "label")} == {"bot", "hub", "organic"}
    ((low, high),) = result("stat_geographic", "min(bot_percent), max(bot_percent)")
    assert low < high


def test_patterns_each_decide_some_location(spark):
    """Every pattern that a profile can meet is the only one of its kind for some location, or meets one at least."""
    rows = catalog.labelled(catalog.c(spark, "/root/testdata/sf0.01")).persist()
    for section in rules.TAXONOMY.values():
        for kind in section.values():
            for spec in kind["patterns"]:
                if set(spec) - set(rules.NOTES) <= set(rows.columns):
                    assert rows.where(rules.pattern(spec, rows.columns)).count(), spec["id"]
    rows.unpersist()
