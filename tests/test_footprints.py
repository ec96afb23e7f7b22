"""Footprints and names on cases that are easily told by eye."""

import datetime as dt
import random

from strataframe.operators import footprints


def ring(*points):
    return " ".join(f"{lat} {lon}" for lon, lat in points)


AREA = ring((10, 50), (11, 50), (11, 51), (10, 51), (10, 50))
SQUARE = ring((9, 49), (12, 49), (12, 52), (9, 52), (9, 49))
CASES = {
    "covers": ([SQUARE], None, "32UPA", ""),
    "inside": ([ring((10.4, 50.4), (10.6, 50.4), (10.6, 50.6), (10.4, 50.6))], None, None, ""),
    "crosses": ([ring((10.5, 40), (10.6, 40), (10.6, 60), (10.5, 60))], None, None, ""),
    "touches a corner": ([ring((11, 51), (12, 51), (12, 52), (11, 52))], None, None, ""),
    "beside": ([ring((12, 50), (13, 50), (13, 51), (12, 51))], None, None, "no_intersection"),
    "one of two": ([ring((12, 50), (13, 50), (13, 51), (12, 51)), SQUARE], None, None, ""),
    "bow tie": ([ring((9, 49), (12, 52), (12, 49), (9, 52))], None, None, "invalid_topology"),
    "spike": ([ring((9, 49), (12, 49), (14, 49), (12, 49), (12, 52), (9, 52))], None, None, "invalid_topology"),
    "touches itself": ([ring((9, 49), (12, 49), (12, 52), (10, 49), (9, 52))], None, None, "invalid_topology"),
    "too short": ([ring((9, 49), (12, 49), (12, 52))], None, None, "malformed_ring"),
    "odd": ([SQUARE + " 5"], None, None, "malformed_ring"),
    "words": ([SQUARE.replace("49", "north")], None, None, "malformed_ring"),
    "far north": ([ring((9, 91), (12, 49), (12, 52), (9, 52))], None, None, "out_of_range"),
    "antimeridian": ([ring((-179, 49), (179, 49), (179, 52), (-179, 52))], None, None, "antimeridian"),
    "first problem": ([ring((9, 49), (12, 52), (12, 49), (9, 52)), "1 2"], None, None, "invalid_topology"),
    "none": ([], None, None, "no_geometry"),
    "null": (None, None, None, "no_geometry"),
    "null ring": ([None], None, None, "malformed_ring"),
    "box": (None, ["49 9 52 12"], None, ""),
    "box the wrong way": (None, ["49 12 52 9"], None, "malformed_ring"),
    "huge": ([ring((0, 40), (20, 40), (20, 60), (0, 60))], None, None, "implausible_area"),
    "huge and beside": ([ring((20, 40), (40, 40), (40, 60), (20, 60))], None, "99XAA", "no_intersection;implausible_area;invalid_tile"),
    "other tile": ([SQUARE], None, "20UPA", "tile_inconsistent"),
    "other band": ([SQUARE], None, "32HPA", "tile_inconsistent"),
    "no band": ([SQUARE], None, "32", "invalid_tile"),
}


def test_issues_of_footprints(spark):
    rows = [(k, *v[:3], AREA, "clash") for k, v in CASES.items()]
    df = spark.createDataFrame(rows, "name string, rings array<string>, boxes array<string>, tile string, area string, issues string")
    got = {r.name: (r.status, r.issues) for r in footprints.footprint_issues(df, ["name"], "rings", "area", boxes="boxes", tile="tile").collect()}
    assert got == {k: ("review_required" if v[3] else "metadata_consistent", v[3]) for k, v in CASES.items()}
    assert footprints.footprint_issues(df.limit(0), ["name"], "rings", "area").count() == 0


def test_polygons_meet_as_a_raster_of_points_says(spark):
    """Convex rings: they meet if some point of a fine raster is in both."""
    import math

    rng, rows = random.Random(4), []
    for i in range(60):
        shapes = []
        for _ in range(2):
            x, y, r = rng.uniform(10, 14), rng.uniform(50, 52), rng.uniform(0.3, 1.2)
            turn = sorted(rng.uniform(0, 2 * math.pi) for _ in range(rng.randint(4, 7)))
            shapes.append([(x + r * math.cos(t), y + r * math.sin(t)) for t in turn])
        rows.append((i, [ring(*shapes[0])], ring(*shapes[1]), shapes))
    df = spark.createDataFrame([r[:3] for r in rows], "id int, rings array<string>, area string")
    got = {r.id: r.issues for r in footprints.footprint_issues(df, ["id"], "rings", "area").collect()}

    def inside(shape, x, y):
        return all((b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) >= 0 for a, b in zip(shape, shape[1:] + shape[:1], strict=True))

    for i, _, _, (one, two) in rows:
        both = any(inside(one, 8.5 + k * 0.02, 48.5 + m * 0.02) and inside(two, 8.5 + k * 0.02, 48.5 + m * 0.02) for k in range(350) for m in range(250))
        assert not both or got[i] == "", (i, got[i])
        assert got[i] in ("", "no_intersection")
    assert {"", "no_intersection"} == set(got.values())


def test_names_and_metadata(spark):
    at = dt.datetime(2021, 7, 4, 1, 2, 3)
    pattern = r"^ECOv(\d{3})_L2T_LSTE_\d+_\d+_\w{5}_(\d{8}T\d{6})_"
    good = "ECOv002_L2T_LSTE_1_2_32UPA_20210704T010203_x"
    rows = [(1, good, at), (2, good, at + dt.timedelta(seconds=1.9)), (3, good, at + dt.timedelta(seconds=2)), (4, good.replace("v002", "v003"), at), (5, "other", at), (6, None, at), (7, good, None), (8, good.replace("0704T", "0799T"), at)]
    out = footprints.name_identity(spark.createDataFrame(rows, "id int, name string, start timestamp"), "name", "start", pattern, "002").collect()
    assert {r.id: r.name_status for r in out} == {1: "consistent", 2: "consistent", 3: "time_differs", 4: "version_differs", 5: "unrecognised_name", 6: "unrecognised_name", 7: "no_start", 8: "unrecognised_name"}
    daily = [(1, "MOD21.A2021185.0102.061.2021186010203.hdf", dt.datetime(2021, 7, 4, 1, 2)), (2, "MOD21.A2021185.0102.061.2021186010203.hdf", dt.datetime(2021, 7, 5, 1, 2)), (3, "MOD21.A2021185.0102.006.2021186010203.hdf", dt.datetime(2021, 7, 4, 1, 2))]
    out = footprints.name_identity(spark.createDataFrame(daily, "id int, name string, start timestamp"), "name", "start", r"^MOD21\.A(\d{7}\.\d{4})\.(\d{3})\.\d{13}(?:\.(?:hdf|nc))?$", "061", groups=(2, 1))
    assert {r.id: r.name_status for r in out.collect()} == {1: "consistent", 2: "time_differs", 3: "version_differs"}
