"""Pairs and groups of near places against all pairs and the loop over places."""

import math
import random

import pytest

from tidelog.operators import proximity


def distance(a, b):
    (p, q), (r, s) = ([math.radians(float(x)) for x in place.split(",")] for place in (a, b))
    h = math.sin((r - p) / 2) ** 2 + math.cos(p) * math.cos(r) * math.sin((s - q) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, h)))


def all_pairs(rows, km):
    return {(c, a, b) for a, c, _ in rows for b, d, _ in rows if a < b and c == d and distance(a, b) <= km}


def loop(rows, km):
    """Each place, by most events and name, joins the first start within reach or starts a group."""
    out = {}
    for country in {c for _, c, _ in rows}:
        starts = []
        for place, _, _ in sorted((r for r in rows if r[1] == country), key=lambda r: (-(r[2] or 0), r[0])):
            first = next((s for s in starts if distance(s, place) <= km), None)
            if first is None:
                starts.append(place)
            out[country, place] = first or place
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "geo_location string, country string, total_downloads long")


def scattered(rng, n, lat, lon, spread):
    return [(f"{lat + rng.uniform(-spread, spread):.4f},{lon + rng.uniform(-spread, spread):.4f}", rng.choice("AB"), rng.randrange(50)) for _ in range(n)]


@pytest.mark.parametrize(
    ("lat", "lon", "spread", "km"), [(48, 9, 0.4, 10), (0, 0, 3, 120), (89.7, 0, 0.29, 10), (-89.9, 170, 0.1, 3), (60, 179.9, 0.6, 25), (0, 0, 80, 4000), (10, 10, 5, 15000)]
)
def test_pairs_equal_all_pairs(spark, lat, lon, spread, km):
    rng = random.Random(int(lat))
    rows = scattered(rng, 120, lat, lon, spread)
    if lon > 170:
        # Across 180 degrees, also where both are written as positive or negative.
        rows += [(f"{lat},{x}", "A", 1) for x in (179.999, -179.999, 180, -180, 180.001)]
    if abs(lat) > 89:
        rows += [(f"{math.copysign(90, lat):.0f},{x}", "B", 1) for x in (0, 77, -120)] + [(f"{lat},{x}", "B", 2) for x in (90, 180, 270, -45)]
    rows = list({(p, c): (p, c, n) for p, c, n in rows}.values())
    got = {(r["country"], r["a"], r["b"]) for r in proximity.near_pairs(frame(spark, rows), km).collect()}
    assert got == all_pairs(rows, km) and got


def test_pairs_of_odd_places(spark):
    rows = [("0,0", None, 1), ("0,0.01", None, 1), ("0,0.01", None, 1), ("x", "A", 1), ("1,y", "A", 1), (None, "A", 1), ("95,0", "A", 1), ("95,0.001", "A", 1), ("", "A", 1), ("nan,nan", "A", 1)]
    assert [tuple(r)[:3] for r in proximity.near_pairs(frame(spark, rows), 10).collect()] == [(None, "0,0", "0,0.01")]
    groups = {(r["country"], r["geo_location"]): r["group"] for r in proximity.proximity_groups(frame(spark, rows), 10).collect()}
    assert groups.pop((None, "0,0.01")) == "0,0"
    assert all(group == place for (_, place), group in groups.items()) and len(groups) == 8
    assert proximity.proximity_groups(frame(spark, [])).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_equal_the_loop(spark, seed):
    rng = random.Random(seed)
    rows = scattered(rng, 150, 50, 8, 0.5 / seed)
    # A chain in which each place waits for the one before it.
    rows += [(f"0,{i * 0.08:.2f}", "A", 100 - i) for i in range(9)] + [("1,1", "B", None)]
    got = {(r["country"], r["geo_location"]): r["group"] for r in proximity.proximity_groups(frame(spark, rows).repartition(5), 10).collect()}
    assert got == loop(rows, 10)
