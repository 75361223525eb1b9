"""Pictures, camera readers, names, whole runs, requests and raw tables on small inputs."""

from __future__ import annotations

import json
import os
import sys
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import config, schema
from tidemark.functions import dates, geometry
from tidemark.operators import events, graphs, grouping, naming, nearest
from tidemark.plans import index, journal, plan, reports, run
from tidemark.sources import camera, images
from tidemark.sources import files as source

T0 = datetime(2024, 5, 1, 10)


def decoder():
    """A function of its own, so that tasks get its code."""
    import os

    import numpy as np

    from tidemark.sources import images

    def pixels(path, edge, gray):
        if path.endswith("bad"):
            raise OSError(path)
        x = np.random.default_rng(int(os.path.basename(path).split("_")[0])).integers(0, 255, (60, 90)).astype(float)
        return np.kron(images.shrink(x, 6), np.ones((12, 12))) + (2 if path.endswith("near") else 0)

    return pixels


def test_pictures_are_kept_and_turned(tmp_path):
    asked = []
    p = images.Pictures(lambda *a: asked.append(a) or np.arange(6).reshape(2, 3), lambda path: 6, most=2)
    first = p.get("x", 10)
    assert first.tolist() == [[3, 0], [4, 1], [5, 2]] and p.get("x", 10) is first and len(asked) == 1
    p.get("y", 10)
    p.get("z", 10)
    p.get("x", 10)
    assert len(asked) == 4
    assert images.upright(np.arange(4).reshape(2, 2), 3).tolist() == [[3, 2], [1, 0]] and images.upright(np.eye(2), 2) is not None
    assert images.Pictures(decoder()).get("1_bad") is None


def test_perceptual_hashes(spark):
    f = spark.createDataFrame([(1, "/p/1_a"), (2, "/p/1_near"), (3, "/p/2_a"), (4, "/p/3_bad")], "id long, path string")
    got = {r.id: r.phash for r in images.with_phashes(f, decoder()).collect()}
    far = lambda a, b: bin(int(a, 16) ^ int(b, 16)).count("1")
    assert len(got[1]) == 16 and far(got[1], got[2]) <= 4 < far(got[1], got[3]) and got[4] is None


def test_thumbnails_and_features(spark, tmp_path):
    f = spark.createDataFrame([(1, "/p/1_a"), (4, "/p/3_bad")], "id long, path string")
    made = images.thumbnails(f, str(tmp_path), decode=decoder(), save=lambda x, path: open(path, "wb").write(b"x") and None)
    assert {r.id: r.thumbnail for r in made.collect()} == {1: f"{tmp_path}/1.jpg", 4: None} and os.path.exists(f"{tmp_path}/1.jpg")
    t = images.Features(lambda paths: [None if p.endswith("bad") else [1.0, 2.0] for p in paths], 2).table(f)
    assert {r.file_id: r.features for r in t.collect()} == {1: [1.0, 2.0], 4: [0.0, 0.0]}


READER = """
import json, sys
buf = []
for line in sys.stdin:
    line = line.strip()
    if line.startswith('-execute'):
        paths = [x for x in buf if not x.startswith('-')]
        if any('die' in p for p in paths):
            sys.exit(1)
        print(json.dumps([{'SourceFile': p, 'Make': 'M'} for p in paths if 'none' not in p]))
        print('{ready' + line[8:] + '}')
        sys.stdout.flush()
        buf = []
    else:
        buf.append(line)
"""


def test_camera_readers(spark, tmp_path):
    r = camera.OpenReader([sys.executable, "-c", READER])
    assert r.read(["a", "none", "b"]) == [{"SourceFile": "a", "Make": "M"}, {}, {"SourceFile": "b", "Make": "M"}]
    assert len(r.read(["c"])) == 1
    with pytest.raises(OSError):
        r.read(["die"])
    assert r.read(["again"])[0]["Make"] == "M"
    r.close()
    once = camera.read_once(["a", "b", "c"], [sys.executable, "-c", "import json,sys; print(json.dumps([{'SourceFile': p} for p in sys.argv[1:] if not p.startswith('-')]))"], size=2)
    assert [x["SourceFile"] for x in once] == ["a", "b", "c"]

    def fails(paths):
        raise OSError("no")

    assert camera.first_that_works([fails, lambda p: [{"k": 1}] * len(p)])(["x"]) == [{"k": 1}]
    got = source.read_with(spark.createDataFrame([("a",), ("b",)], "path string"), lambda p: [{"v": x} for x in p] if p == ["a"] else fails(p), "v string").collect()
    assert {x.path: (x.v, x.read_error) for x in got} == {"a": ("a", None), "b": (None, "OSError: no")}


def test_signatures_of_any_length(spark):
    rows = [(1, "00ff"), (2, "00FE"), (3, "00" * 12), (4, "00" * 11 + "07"), (5, "0" * 16), (6, "0" * 15 + "1"), (7, None), (8, "")]
    df = spark.createDataFrame(rows, "id long, s string")
    assert {(r.a, r.b, r.distance) for r in graphs.near_pairs(df, "id", "s", 3).collect()} == {(1, 2, 1), (3, 4, 3), (5, 6, 1)}
    assert df.select(geometry.hamming(F.lit("00"), F.lit("000")).alias("d")).first().d is None
    assert graphs._blocks(100, 5) == 6 < graphs._blocks(10**8, 5) <= 8


def test_numbers_without_one_partition(spark):
    d = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x"), F.lit("v").alias("y")).repartition(5)
    got = grouping.numbered(d, ["x"], "n", 10).collect()
    assert sorted(r.n for r in got) == list(range(11, 1011)) and all(r.n == r.x + 11 for r in got)
    assert grouping.numbered(d.limit(0), ["x"]).count() == 0


def test_dates_in_names(spark):
    names = {
        "IMG_20190705_123456.jpg": "2019-07-05 12:34:56", "IMG-20200102-WA0003.jpg": "2020-01-02 00:00:00", "2021-03-04 at 05.06.07.png": "2021-03-04 05:06:07", "20190705_123456789.jpg": "2019-07-05 12:34:56",
        "2018-02-03.jpg": "2018-02-03 00:00:00", "x20170102y.jpg": "2017-01-02 00:00:00", "20231399_999999.jpg": None, "12345678901.jpg": None, "18991231.jpg": None, "a.jpg": None, "20190705_250000.jpg": "2019-07-05 00:00:00",
    }
    d = spark.createDataFrame([(n,) for n in names], "n string").select("n", dates.from_filename(F.col("n")).cast("string").alias("t"))
    assert {r.n: r.t for r in d.collect()} == names


def test_names_of_events(spark):
    ev = spark.createDataFrame([(1, T0, T0, "Oslo", "old", False, "auto"), (2, T0, T0, None, "Mine", True, "manual"), (3, T0, T0, None, "2024-05-01", False, "auto"), (4, T0, T0, "x", "keep", False, "auto")], schema.EVENTS)
    ef = spark.createDataFrame([(1, 10), (1, 11), (4, 12)], schema.EVENT_FILES)
    f = spark.createDataFrame([(10, "/b.jpg", T0 + timedelta(hours=1)), (11, "/a.jpg", T0), (12, "/c.jpg", T0)], "id long, path string, taken_at timestamp_ntz")

    def namer(o):
        if o.place == "x":
            raise RuntimeError("busy")
        return f"{o.place}: {','.join(o.samples)}" if o.samples else "2024-05-01"

    named, stats = naming.name_events(ev, naming.by_provider(ev, ef, f, namer))
    assert {r.id: r.name for r in named.collect()} == {1: "Oslo: /a.jpg,/b.jpg", 2: "Mine", 3: "2024-05-01", 4: "keep"}
    assert stats == {"total": 3, "failed": 1, "unchanged": 1, "renamed": 1, "manual_kept": 1}


def test_places_by_grids_of_any_distance(spark):
    rng = np.random.default_rng(5)
    world = [(i, float(rng.uniform(-80, 80)), float(rng.uniform(-180, 180))) for i in range(60)]
    p = spark.createDataFrame(world, "geonameid long, lat double, lon double")
    points = [(float(rng.uniform(-89, 89)), float(rng.uniform(-180, 180))) for _ in range(80)] + [(0.0, 179.9), (0.0, -179.9), (89.5, 10.0)]
    d = spark.createDataFrame(points, "lat double, lon double")
    a, b = nearest.nearest(d, p).collect(), nearest._by_cells(d, p, "geonameid").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and len(a) == 83


def test_countries_by_majority(spark):
    rows = [(i, T0 + timedelta(minutes=i), "high", None, None, c, l, None, None, None, l, None, None) for i, (c, l) in enumerate([("FR", "i:1"), ("FR", "i:1"), ("IT", "i:2"), ("IT", "i:2"), ("IT", "i:2"), ("IT", None)])]
    f = spark.createDataFrame(rows, "id long, taken_at timestamp_ntz, taken_at_confidence string, dup_of long, error string, country string, locality string, region string, lat double, lon double, place_name string, region_name string, country_name string")
    ev, files = events.build(f)
    assert [r.place_city for r in ev.collect()] == ["i:2"] and files.count() == 6


def _index(spark, folder):
    folder.mkdir()
    for name, data in (("a.jpg", b"a"), ("b.jpg", b"bb"), ("c.jpg", b"ccc"), ("IMG_20200101_101010.jpg", b"d")):
        (folder / name).write_bytes(data * 6000)
    f = index.assign_duplicates(index.update_index(spark, spark.createDataFrame([], schema.FILES), [str(folder)]))
    sign = F.when(F.col("path").endswith("c.jpg"), "f" * 16).otherwise("0" * 16)
    f = f.withColumn("phash", F.when(F.col("path").contains("IMG"), F.lit(None)).otherwise(sign)).withColumn("taken_at_confidence", F.lit("high"))
    none = lambda s: spark.createDataFrame([], s)
    return run.Tables(f, none(schema.PLACES), none(schema.MEDIA_CLASS), none(schema.DEDUP_CHOICE), none(schema.FACES), none(schema.FACE_CLUSTERS), none(schema.EVENTS), none(schema.EVENT_FILES))


def test_plan_and_sort_and_back(spark, tmp_path):
    t = _index(spark, tmp_path / "in")
    out = tmp_path / "out"
    made, report = run.plan_and_sort(t, "event", str(out), str(tmp_path / "reports"), dedupe=True)
    assert report is None and made.count() == 4
    roles = {os.path.basename(r.path): (r.near_dup_role, r.reason) for r in made.collect()}
    assert roles["b.jpg"] == ("kept", "no_event") and roles["a.jpg"] == ("moved", "near_dup") and roles["c.jpg"][0] is None
    page = (tmp_path / "reports" / "plan_event.html").read_text()
    assert "Near duplicates 1" in page and "a.jpg | " in page and "_Duplicates (1)" in page
    led = journal.Ledger(spark, str(tmp_path / "ledger"))
    made, report = run.plan_and_sort(t, "event", str(out), str(tmp_path / "reports"), led, dedupe=True, delete_worse=True)
    assert (report.done, report.deleted, report.failed) == (3, 1, 0) and not (tmp_path / "in" / "a.jpg").exists()
    now = {os.path.basename(r.path): r.path for r in run.moved_paths(t.files, led, 1).collect()}
    assert os.path.exists(now["b.jpg"]) and now["b.jpg"].startswith(str(out))
    one = run.counters(made, str(out)).first()
    assert one.files == 4 and one.reasons["near_dup_delete"] == 1 and one.below_root == 4
    assert journal.undo(led).done == 3 and (tmp_path / "in" / "b.jpg").exists()


def test_trash_requests_and_language(spark, tmp_path):
    f = spark.createDataFrame([(1, "/1"), (2, "/2"), (3, "/3")], "id long, path string")
    c = spark.createDataFrame([(1, "keep", ""), (3, "keep", "")], schema.DEDUP_CHOICE)
    binned = []
    left, choice, n = run.trash_group(f, c, spark.createDataFrame([(1,), (2,), (9,)], "id long"), 2, binned.append)
    assert (sorted(r.id for r in left.collect()), [r.file_id for r in choice.collect()], n, binned) == ([2, 3], [3], 1, ["/1"])
    assert [r.path for r in run.paths_of(f, [3]).collect()] == ["/3"]
    rows = spark.createDataFrame([(1, "b"), (2, ""), (3, "a")], "id long, x string")
    assert [r.id for r in run.sorted_rows(rows, "x", True).collect()] == [1, 3, 2] and [r.id for r in run.sorted_rows(rows, "x").collect()] == [3, 1, 2]
    assert run.request("files", {"file_ids": [3, 1, 3]}) == {"file_ids": [3, 1]}
    assert run.request("plan", {"mode": "city", "dest": "/x", "where": ["year=2020"]})["where"] == ["year=2020"]
    for kind, body in (("file", []), ("file", {"file_id": True}), ("files", {"file_ids": []}), ("files", {"file_ids": [1, "2"]}), ("choice", {"file_id": 1, "action": "burn"}), ("group", {"group": [1, 2], "keep_file_id": 3}), ("rename", {"event_id": 1, "name": " "}), ("language", {"language": "xx"})):
        with pytest.raises(ValueError):
            run.request(kind, body)
    p = tmp_path / "c.yaml"
    p.write_text("# mine\nlanguage: en  # old\ngeo:\n  session_gap_hours: 3\n")
    run.save_language(str(p), "ja")
    assert p.read_text().startswith("# mine\nlanguage: ja\ngeo:") and config.load(str(p)).language == "ja"
    run.save_language(str(tmp_path / "new.yaml"), "xx")
    assert config.load(str(tmp_path / "new.yaml")).language == "en"


def test_geocoder_asks_a_cell_once(spark):
    asked = []
    fetch = lambda a, b: asked.append((a, b)) or {"country_code": "fr", "village": "V", "quarter": "Q"}
    d = spark.createDataFrame([(1.0001, 2.0), (3.0, 4.0)], "lat double, lon double")
    known = source.geocode_online(d.limit(1), fetch)
    again = source.geocode_online(d, fetch, known=spark.createDataFrame(known.collect(), source.GEOCODED), interval=0.01)
    assert len(asked) == 2 and {(r.lat_r, r.city, r.district_name) for r in again.collect()} == {(1.0, "V", "Q"), (3.0, "V", "Q")}


def test_raw_tables(spark, tmp_path):
    line = lambda n, cells: "\t".join(str(cells.get(k, "")) for k in range(n))
    (tmp_path / "all.txt").write_text(line(19, {0: 1, 2: "Moscow", 4: 55.7, 5: 37.6, 7: "PPLC", 8: "RU", 10: 48, 14: 9}) + "\nshort\n")
    source.write_tsv(source.build_places(spark, str(tmp_path / "all.txt")), str(tmp_path / "places"))
    r = source.places_tsv(spark, str(tmp_path / "places")).first()
    assert (r.geonameid, r.lat, r.fcode, r.admin1, r.name_en, r.population) == (1, 55.7, "PPLC", "48", "Moscow", 9)
    (tmp_path / "a1.txt").write_text("RU.48\tМосква\tMoscow\t5\nbad\tx\ty\t6\n")
    assert [tuple(x) for x in source.build_admin1(spark, str(tmp_path / "a1.txt")).collect()] == [("RU", "48", "5", "Moscow")]
    (tmp_path / "c.txt").write_text("#comment\n" + line(19, {0: "RU", 4: "Russia", 16: 7}) + "\n" + line(19, {0: "XX", 4: "None"}) + "\n")
    assert [tuple(x) for x in source.build_countries(spark, str(tmp_path / "c.txt")).collect()] == [("RU", "7", "Russia")]
    (tmp_path / "n.txt").write_text("1\t1\tru\tа\t\n2\t1\tru\tб\t1\n3\t1\tru\tв\t\n4\t1\tfr\tx\t\n5\t9\tru\tx\t\n")
    ids = spark.createDataFrame([(1,)], "geonameid long")
    assert [tuple(x) for x in source.build_names(spark, str(tmp_path / "n.txt"), ids).collect()] == [(1, "ru", "б")]


def test_contact_sheet_page(spark, tmp_path):
    sheet = spark.createDataFrame([("/a b.jpg", [1.2, 2.0, 3.0, 4.0]), ("/c<.jpg", None)], "path string, bbox array<double>")
    assert reports.write_contact_sheet(sheet, str(tmp_path / "s.html"), "Ann & Bob") == 2
    page = (tmp_path / "s.html").read_text()
    assert "Ann &amp; Bob" in page and "file:///a%20b.jpg" in page and "[1, 2, 3, 4]" in page and "/c&lt;.jpg" in page


def test_scan_deals_folders(spark, tmp_path):
    want = set()
    for k in range(30):
        p = tmp_path / f"d{k % 7}" / f"e{k % 3}" / f"{k}.jpg"
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x" * 6000)
        want.add(str(p))
    (tmp_path / "top.png").write_bytes(b"x" * 6000)
    (tmp_path / ".hid").mkdir()
    (tmp_path / ".hid" / "x.jpg").write_bytes(b"x" * 6000)
    for parts in (1, 8):
        assert {r.path for r in source.scan(spark, [str(tmp_path)], partitions=parts).collect()} == want | {str(tmp_path / "top.png")}
    assert json.loads(json.dumps(sorted(want)))


def test_near_dup_routing_words(spark):
    d = spark.createDataFrame([(1, "city", 10, 10, 5, ["X"]), (2, "city", 20, 10, 1, ["X"])], "id long, reason string, width int, height int, size long, parts array<string>")
    g = spark.createDataFrame([(1, 1), (1, 2)], "group_no int, id long")
    got = {r.id: (r.near_dup_role, r.reason, r.parts) for r in plan.route_near_dups(d, g, "ru").collect()}
    assert got == {1: ("moved", "near_dup", ["_Дубликаты"]), 2: ("kept", "city", ["X"])}
