import math
import random

from tessera.functions.spatial import RADIUS
from tessera.operators import spatial


def metres(a, b):
    (lon, lat), (x, y) = (map(math.radians, p) for p in (a, b))
    h = math.sin((y - lat) / 2) ** 2 + math.cos(lat) * math.cos(y) * math.sin((x - lon) / 2) ** 2
    return 2 * RADIUS * math.asin(math.sqrt(min(1.0, h)))


def test_batch_nearest_is_exact_where_points_are_few(spark):
    rng = random.Random(6)
    points = [(k, rng.gauss(-9, 0.3), rng.gauss(38, 0.3)) for k in range(150)] + [(200 + k, rng.uniform(-180, 180), rng.uniform(-85, 85)) for k in range(20)]
    points += [(300, 179.95, 10.0), (301, -179.95, 10.0), (302, -9.0, 39.75), (303, None, 1.0)]
    sites = [(k, rng.gauss(-9, 1.5), rng.gauss(38, 1.5)) for k in range(25)] + [(90, 179.9, 10.0), (91, 0.0, 89.9), (92, 60.0, -60.0), (93, -9.0, 39.26)]
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} long, lon double, lat double")
    found = spatial.batch_nearest(frame(sites, "site"), frame(points, "id"), 3, "id", "site", 0.5).collect()
    mine = {}
    for r in sorted(found, key=lambda r: (r.site, r["rank"])):
        mine.setdefault(r.site, []).append(r.id)
    want = {s: [p[0] for p in sorted((p for p in points if p[1] is not None), key=lambda p: (metres((x, y), p[1:]), p[0]))[:3]] for s, x, y in sites}
    assert mine == want


def test_batch_nearest_ranks_points_as_far_away_by_key(spark):
    """Places mirrored at the site's meridian, whose computed distances differ in the last bits."""
    places = [(38.0 + k % 40 / 10, 0.01 * (1 + k % 7)) for k in range(280)]
    for flip in (1, -1):
        points = [(10 * k + side, -9.0 + (flip if side else -flip) * d, y) for k, (y, d) in enumerate(places) for side in (0, 1)]
        sites = [(k, -9.0, y) for k, (y, _) in enumerate(places)]
        frame = lambda rows, name: spark.createDataFrame(rows, f"{name} long, lon double, lat double")
        found = {}
        for r in spatial.batch_nearest(frame(sites, "site"), frame(points, "id"), 4, "id", "site", 0.5).collect():
            found.setdefault(r.site, {})[r["rank"]] = r.id
        want = {s: [p[0] for p in sorted(points, key=lambda p: (round(metres((x, y), p[1:]), 4), p[0]))[:4]] for s, x, y in sites}
        assert {s: [v[r] for r in sorted(v)] for s, v in found.items()} == want


def test_batch_nearest_ranks_few_rows_of_copies(spark, monkeypatch):
    """Copies of places and of sites: each different place of a site meets each different place of a point once."""
    points = [(k, -9.0 + k % 7 / 100, 38.0 + k % 5 / 100) for k in range(1400)]
    sites = [(k, -9.0 + k % 3 / 100, 38.0 + k % 2 / 50) for k in range(600)]
    ranked, rows = spatial._ranked, []

    def counted(near, points, *rest):
        rows.append((near.count(), points.count()))
        return ranked(near, points, *rest)

    monkeypatch.setattr(spatial, "_ranked", counted)
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} long, lon double, lat double")
    found = {(r.site, r["rank"]): r.id for r in spatial.batch_nearest(frame(sites, "site"), frame(points, "id"), 3, "id", "site", 0.5).collect()}
    want = {(s, n + 1): p[0] for s, x, y in sites for n, p in enumerate(sorted(points, key=lambda p: (round(metres((x, y), p[1:]), 6), p[0]))[:3])}
    assert found == want
    assert rows[0] == (6 * 9, 35)
