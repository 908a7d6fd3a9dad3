"""Entry points, registries, providers and the command line."""

import json

import pytest

import __spark_entry__ as entry
from tidelog import registry
from tidelog.cli import main, parser
from tidelog.fixtures import view_c
from tidelog.sources import providers


def test_every_query_has_unique_columns_and_known_oracles():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 80


def test_entry_labels_locations(spark):
    rows = {r["label"]: r["downloads"] for r in entry.entry(spark).collect()}
    assert sum(rows.values()) == view_c(spark, "/root/testdata/sf0.001").count()


def test_feature_registry():
    assert registry.get("weekly_autocorr").category == "periodicity"
    assert registry.get("http_ratio").default == 1.0
    assert {f.name for f in registry.by_stage("after_anomaly")} >= {"bot_composite_score", "request_velocity"}
    assert registry.missing_needs(["country_zscore"]) == {"country_zscore": ["downloads_per_user"]}
    assert sum(registry.summary().values()) == len(registry.FEATURES) > 130


def test_providers_from_yaml(tmp_path):
    (tmp_path / "web.yaml").write_text("schema: {user_field: ip}\nbehavior_type: {organic: {patterns: [{id: x, unique_users: {max: 2}}]}}\n")
    assert providers.discover(str(tmp_path)) == ["web"]
    web = providers.get("web")
    assert web.schema.user_field == "ip"
    assert [p["id"] for p in web.taxonomy["behavior_type"]["organic"]["patterns"]] == ["x"]
    assert web.taxonomy["behavior_type"]["automated"] == providers.get("default").taxonomy["behavior_type"]["automated"]
    with pytest.raises(ValueError, match="unknown"):
        providers.from_dict("bad", {"schema": {"nothing": 1}})
    with pytest.raises(KeyError):
        providers.get("nothing")


def test_command_line(spark, tmp_path):
    from tidelog.fixtures import view_a

    assert parser().parse_args(["a", "b"]).method == "rules"
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "own.yaml").write_text("schema: {city_field: city, user_field: usr, timestamp_field: ts, id_field: event_id}\n")
    log = str(tmp_path / "log.parquet")
    view_a(spark, "/root/testdata/sf0.001").write.parquet(log)
    out = main([log, str(tmp_path / "out"), "--providers-dir", str(tmp_path / "p"), "--provider", "own", "--html"])
    assert spark.read.parquet(out["output"]).count() == spark.read.parquet(log).count()
    assert json.loads((tmp_path / "out" / "summary.json").read_text())["locations"] == out["locations"]


def test_public_names_and_views(spark):
    import tidelog

    assert all(callable(getattr(tidelog, name)) for name in tidelog.__all__)
    tidelog.register({"clean_places": spark.createDataFrame([("L",)], "geo_location string")})
    assert spark.sql("SELECT geo_location FROM clean_places").first()[0] == "L"


def test_least_year_applies_to_the_operators_it_is_asked_for(spark):
    from tidelog.plans import pipeline
    from tidelog.schema import get_schema, override

    rows = [("L", "C", "x", f"u{i % 3}", "A", "http", f"f{i}.raw", f"{2018 + i % 4}-0{1 + i % 9}-11 0{i % 10}:00:00", i) for i in range(40)] + [("old", "C", "x", "u", "A", "http", "f", "2011-01-01", 99)]
    names = "geo_location string, country string, city string, usr string, accession string, method string, filename string, ts string, event_id long"
    events, schema = spark.createDataFrame(rows, names), override(get_schema("canonical"), min_year=2020)
    by_default = pipeline.location_profile(events, schema).collect()
    assert [(r["geo_location"], r["total_downloads"], r["years_span"]) for r in by_default] == [("L", 20, 2)]
    everywhere = frozenset({*pipeline.RECENT, "base_behavior"})
    since = pipeline.location_profile(events, schema, recent=everywhere).first()
    assert since["num_sessions"] < by_default[0]["num_sessions"]
    assert pipeline.location_profile(events, schema, recent=frozenset()).count() == 2
