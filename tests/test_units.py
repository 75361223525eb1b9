"""Operators on small tables: semantics that the test tables do not reach."""

from __future__ import annotations

import os
from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark import config, schema
from tidemark.functions import dates, geometry, text, words
from tidemark.operators import clusters, events, graphs, grouping, nearest, places, sessions
from tidemark.plans import index, journal, plan, reports, where
from tidemark.sources import files as source
from tidemark.sources import tables
from tidemark.streaming import events as streams

T0 = datetime(2024, 5, 1, 10)


def one(spark, **cols):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()])


def test_filename_and_exif_dates(spark):
    names = {"IMG_20190705_123456.jpg": "2019-07-05 12:34:56", "PXL_20210101_101112000.jpg": "2021-01-01 10:11:12", "WhatsApp Image 2020-05-01 at 12.34.56.jpeg": "2020-05-01 12:34:56",
             "photo_2019-07-05_12-34-56.jpg": "2019-07-05 12:34:56", "img-20190705-wa0001.jpg": "2019-07-05 00:00:00", "2019-07-05.png": "2019-07-05 00:00:00", "20190705.png": "2019-07-05 00:00:00",
             "IMG_19890705_123456.jpg": None, "20191399.jpg": None, "120190705.jpg": None, "DSC001.jpg": None}
    rows = spark.createDataFrame(list(names.items()), "n string, want string")
    bad = rows.withColumn("got", F.date_format(dates.from_filename(F.col("n")), "yyyy-MM-dd HH:mm:ss")).where("NOT (got <=> want)").collect()
    assert bad == []
    exif = {"2019:07:05 12:34:56": 2019, "2019-07-05 12:34:56+02:00": 2019, "2019:07:05": 2019, "": None, "0000:00:00 00:00:00": None, "2036:01:01 00:00:00": None}
    rows = spark.createDataFrame(list(exif.items()), "e string, want int")
    assert rows.withColumn("got", F.year(dates.from_exif(F.col("e")))).where("NOT (got <=> want)").collect() == []
    assert dates.parse_bound("2024-01-02", True) == datetime(2024, 1, 2, 23, 59, 59, 999999)


def test_names(spark):
    cases = {"a<b>:c": "a_b__c", "  x. ": "x", "": "_", " . ": "_", "con.txt": "_con.txt", "LPT1": "_LPT1", "ok": "ok", "a\x01b": "a_b"}
    df = spark.createDataFrame(list(cases.items()), "n string, want string")
    assert df.withColumn("got", text.sanitize(F.col("n"))).where("NOT (got <=> want)").collect() == []
    gen = {'"Day at the sea."\nmore': "Day at the sea", "": None, "a/b:  c": "a b c", "x" * 90: "x" * 80}
    df = spark.createDataFrame(list(gen.items()), "n string, want string")
    assert df.withColumn("got", text.sanitize_generated(F.col("n"))).where("NOT (got <=> want)").collect() == []
    r = one(spark, a="straße", b="STRASSE", p="/x/SCREENSHOTS/a b.png", n="Снимок экрана 1.png").select(text.same_folded(F.col("a"), F.col("b")), text.in_screenshot_folder(F.col("p")), text.is_screenshot_name(F.col("n")), text.file_uri(F.col("p"))).first()
    assert tuple(r) == (True, True, True, "file:///x/SCREENSHOTS/a%20b.png")
    r = spark.createDataFrame([("/a/b",), ("/a/b/c",), ("/a/bc",)], "p string").where(text.below(F.col("p"), "/a/b/")).count()
    assert r == 2 and words.folder("junk", "xx") == "junk" and words.language("JA") == "ja"


def test_geometry(spark):
    r = one(spark, a="ffffffffffffffff", b="0000000000000001", c="7fffffffffffffff").select(geometry.hamming(F.col("a"), F.col("b")), geometry.hamming(F.col("a"), F.col("c"))).first()
    assert tuple(r) == (63, 1)
    boxes = F.array(F.array(F.lit(0), F.lit(50), F.lit(0), F.lit(10)))
    polys = F.array(F.array(F.array(F.lit(0), F.lit(0)), F.array(F.lit(10), F.lit(0)), F.array(F.lit(0), F.lit(10))))
    assert spark.range(1).select(geometry.text_fraction(boxes, polys, F.lit(100), F.lit(10))).first()[0] == pytest.approx(0.55)
    assert spark.range(1).select(geometry.coordinate(F.lit("")), geometry.coordinate(F.lit("1.5"))).first()[1] == 1.5


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(0, 60 * 60 * 60), min_size=1, max_size=40))
def test_overall_sessions_equal_a_loop(spark, seconds):
    rows = [(i, T0 + timedelta(seconds=s)) for i, s in enumerate(seconds)]
    got = {r.id: r.session for r in sessions.overall(spark.createDataFrame(rows, "id long, ts timestamp_ntz"), "ts", ["id"], 3600).collect()}
    n, last = 0, None
    for i, ts in sorted(rows, key=lambda r: (r[1], r[0])):
        n += last is None or (ts - last).total_seconds() > 3600
        last = ts
        assert got[i] == n


def test_inherit_ties(spark):
    rows = [(1, 0, True), (2, 10, False), (3, 20, True), (4, 20, True), (5, 21, False)]
    df = spark.createDataFrame([(1, i, T0 + timedelta(minutes=m), s) for i, m, s in rows], "k int, id long, ts timestamp_ntz, src boolean")
    got = sessions.inherit_nearest(df.withColumn("v", F.col("id")), ["k"], "ts", "id", F.col("src"), F.lit(True), ["v"])
    assert {r.id: r.inherited.v for r in got.collect() if r.inherited} == {2: 1, 5: 3}


def test_near_pairs_find_all(spark):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 30)
    vals = [int(b) ^ sum(1 << int(k) for k in rng.choice(64, d, replace=False)) for b in base for d in (0, 0, 2, 5, 6)]
    df = spark.createDataFrame([(i, f"{v:016x}") for i, v in enumerate(vals)], "id long, s string")
    want = {(i, j) for j in range(len(vals)) for i in range(j) if (vals[i] ^ vals[j]).bit_count() <= 5}
    assert {(r.a, r.b) for r in graphs.near_pairs(df, "id", "s", 5).collect()} == want


def test_merge_chains(spark):
    c = spark.createDataFrame([(1, "A", None), (2, None, 1), (3, None, 2), (4, None, None), (5, "x", 6), (6, None, 5)], schema.FACE_CLUSTERS)
    assert {(r.id, r.root) for r in graphs.roots(c).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4)}
    m = graphs.merge_clusters(c, 3, 4)
    assert graphs.root_of(m, 2) == 4 and m.where("id = 4").first().label == "A"
    with pytest.raises(ValueError):
        graphs.root_of(c, 5)
    assert graphs.label_root(c, 3, "B").where("id = 1").first().label == "B"


def _world(spark):
    p = spark.createDataFrame([(1, 55.75, 37.62, "PPLC", "RU", "48", "", "Moscow", 1), (2, 55.70, 37.50, "PPLX", "RU", "48", "", "Ramenki", 1), (3, 48.85, 2.35, "PPLC", "FR", "11", "", "Paris", 1)], "geonameid long, lat double, lon double, fcode string, cc string, admin1 string, admin2 string, name_en string, population long")
    names = spark.createDataFrame([(1, "ru", "Москва"), (2, "en", "Ramenki dist.")], "geonameid long, lang string, name string")
    none = spark.createDataFrame([], "cc string, admin1 string, geonameid long, name_en string")
    return {"places": p, "names": names, "admin1": none, "countries": none.drop("admin1")}


def test_places_of_files(spark):
    w = _world(spark)
    rows = [(1, T0, "high", 55.701, 37.501, None, None), (2, T0 + timedelta(hours=1), "high", None, None, None, None), (3, T0 + timedelta(hours=30), "medium", None, None, None, None), (4, None, None, 48.9, 2.3, None, None), (5, T0, "low", None, None, None, None), (6, T0, "high", None, None, 1, None)]
    f = spark.createDataFrame(rows, "id long, taken_at timestamp_ntz, taken_at_confidence string, gps_lat double, gps_lon double, dup_of long, error string")
    got = {r.file_id: (r.country, r.city_geonameid, r.district_geonameid, r.confidence) for r in places.resolve_places(f, w["places"]).collect()}
    assert got == {1: ("RU", 1, 2, "exact_gps"), 2: ("RU", 1, 2, "session_inferred"), 3: (None, None, None, "unknown"), 4: ("FR", 3, None, "exact_gps"), 5: (None, None, None, "unknown")}
    ids = spark.createDataFrame([(1,), (2,), (3,), (9,)], "gid long")
    named = {r.gid: (r.name, r.name_exact) for r in nearest.localized(ids, "gid", w, "ru").collect()}
    assert named == {1: ("Москва", True), 2: ("Ramenki dist.", False), 3: ("Paris", False), 9: ("9", False)}
    a = nearest.nearest(f.where("gps_lat IS NOT NULL"), w["places"], "gps_lat", "gps_lon")
    b = nearest._by_cells(a.select("lat", "lon"), w["places"], "geonameid")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_events_from_files(spark):
    rows = []
    for d, city, n in ((0, 1, 3), (1, 1, 3), (10, 3, 5), (20, 1, 2)):
        rows += [(len(rows) + k, T0 + timedelta(days=d, minutes=k), "high", None, None, "RU" if city == 1 else "FR", f"i:{city}", None, None, None, {1: "Moscow", 3: "Paris"}[city]) for k in range(n)]
    f = spark.createDataFrame(rows, "id long, taken_at timestamp_ntz, taken_at_confidence string, dup_of long, error string, country string, locality string, region string, lat double, lon double, place_name string")
    ev, ef = events.build(f)
    assert sorted(r.name for r in ev.collect()) == ["2024-05-01..05-02 Moscow", "2024-05-11 Paris"] and ef.count() == 11
    renamed = events.rename(ev, ev.orderBy("started_at").first().id, "Spring")
    kept = events.keep_manual_names(ev, ef, renamed, ef)
    assert kept.where("name = 'Spring' AND name_is_manual").count() == 1
    more, files2 = events.add_manual(tables.stage(ev, "e"), tables.stage(ef, "f"), f, "Party", "2024-05-11", "2024-05-11")
    assert {r.name for r in more.collect()} == {"2024-05-01..05-02 Moscow", "Party"} and files2.count() == 11
    with pytest.raises(ValueError):
        events.add_manual(tables.stage(more, "e"), files2, f, "Again", "2024-05-11", "2024-05-12")


def test_density_clusters(spark):
    rng = np.random.default_rng(42)
    x, size = [], (8, 8, 6)
    for axis, n in enumerate(size):
        v = rng.normal(size=(n, 64)) * 0.05
        v[:, axis] += 1
        x.append(v / np.linalg.norm(v, axis=1, keepdims=True))
    noise = np.eye(64)[40:43]
    v = np.concatenate([*x, noise])
    got = clusters.density_labels(v, 5, 1.0)
    assert [len(set(got[a:b])) for a, b in ((0, 8), (8, 16), (16, 22))] == [1, 1, 1] and len({got[0], got[8], got[16]}) == 3 and (got[22:] == -1).all()
    faces = spark.createDataFrame([(i, i, [0.0, 0.0, 1.0, 1.0], [float(a) for a in r]) for i, r in enumerate(v)] + [(99, 99, [], None)], "id long, file_id long, bbox array<double>, embedding array<float>")
    c = clusters.cluster_faces(faces, width=64)
    assert c.count() == 25 and c.where("cluster_id IS NULL").count() == 3
    old = spark.createDataFrame([(i, 7, "Ann") for i in range(5)] + [(8, 8, "Bob")], "id long, root long, label string")
    assert [tuple(r) for r in clusters.inherit_labels(c, old).collect()] == [(1, "Ann")]


def test_density_clusters_of_many(spark):
    """More vectors than the 50,000 that were allowed once: two bundles, one cluster each."""
    k = F.col("id")
    v = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.when(i == k % 2, 1.0).otherwise(0.01 * F.sin(k * (i + 1))))
    faces = spark.range(50_001).select("id", F.array(*[F.lit(0.0)] * 4).alias("bbox"), v.alias("embedding"))
    c = clusters.cluster_faces(faces, width=3)
    assert c.count() == 50_001 and c.where("cluster_id IS NULL OR cluster_id <> 1 + id % 2").count() == 0


def test_targets_skip_natural_names_and_disk(spark):
    rows = [(1, "/s/1/a.jpg"), (2, "/s/2/a.jpg"), (3, "/s/3/a_1.jpg"), (4, "/s/4/a.jpg"), (5, "/s/5/b.jpg"), (6, "/t/c.jpg"), (7, "/s/7/c.jpg")]
    d = spark.createDataFrame([(i, p, "/t", p.rsplit("/", 1)[1]) for i, p in rows], "id long, path string, folder string, name string")
    disk = spark.createDataFrame([("/t", "b.jpg"), ("/t", "c.jpg")], "folder string, name string")
    got = {r.id: r.target for r in plan.assign_targets(d, taken=disk).collect()}
    assert got == {1: "/t/a.jpg", 2: "/t/a_1.jpg", 3: "/t/a_1_1.jpg", 4: "/t/a_2.jpg", 5: "/t/b_1.jpg", 6: "/t/c.jpg", 7: "/t/c_1.jpg"}


def test_filters_reject_and_roles(spark):
    for bad in ("colour=red", "year=x", "city>a", "nonsense"):
        with pytest.raises(ValueError):
            where.parse([bad])
    assert where.parse(["Year >= 2020"])[0] == where.Term("year", ">=", "2020")
    d = spark.createDataFrame([(1, "city", 10, 10, 5), (2, "city", 20, 10, 1), (3, "junk", 99, 99, 9), (4, "city", 1, 1, 1)], "id long, reason string, width int, height int, size long")
    g = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 3), (2, 4)], "group_no int, id long")
    assert {r.id: (r.near_dup_group, r.near_dup_role) for r in plan.near_dup_roles(d, g).collect()} == {1: (1, "moved"), 2: (1, "kept")}


def test_index_apply_and_undo(spark, tmp_path):
    src = tmp_path / "in"
    for name, data in {"IMG_20190705_123456.jpg": b"a", "copy.jpg": b"a", "_odd.png": b"c", "small.jpg": None, "x.txt": b"z", ".hid/a.jpg": b"h", "Movie.S01E01.mp4": b"m"}.items():
        p = src / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"s" if data is None else data * 6000)
    none = spark.createDataFrame([], schema.FILES)
    f = tables.stage(index.assign_duplicates(index.update_index(spark, none, [str(src)])), "index")
    by = {os.path.basename(r.path): r for r in f.collect()}
    assert set(by) == {"IMG_20190705_123456.jpg", "copy.jpg", "_odd.png", "Movie.S01E01.mp4"} and by["Movie.S01E01.mp4"].not_personal
    assert sum(r.dup_of is not None for r in by.values()) == 1 and by["IMG_20190705_123456.jpg"].taken_at_source == "filename"
    again = tables.changes(f, source.scan(spark, [str(src)])).groupBy("action").count().collect()
    assert [(r.action, r["count"]) for r in again] == [("skip", 4)]
    led = journal.Ledger(spark, str(tmp_path / "ledger"))
    todo = [(r.id, r.path, str(tmp_path / "out" / os.path.basename(r.path)), r.hash) for r in by.values()]
    (src / "copy.jpg").write_bytes(b"changed")
    before = {p.name: p.read_bytes() for p in src.iterdir() if p.is_file()}
    rep = journal.apply(led, 1, todo)
    assert (rep.done, rep.failed) == (3, 1) and led.last_batch() == 1 and led.payload(1, str(tmp_path)).count() == 4
    back = journal.undo(led)
    assert back.done == 3 and {p.name: p.read_bytes() for p in src.iterdir() if p.is_file()} == before and led.last_batch() is None


def test_tables_and_reports(spark, tmp_path):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "path string, size long")
    path = str(tmp_path / "t")
    old.write.parquet(path)
    new = spark.createDataFrame([("b", 3), ("c", 4)], "path string, size long")
    tables.replace(tables.upsert(spark.read.parquet(path), new, ["path"]), path)
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [("a", 1), ("b", 3), ("c", 4)]
    g = tables.guarded_update(old, F.col("size") > 1, {"size": F.lit(9)})
    assert sorted(map(tuple, g.collect())) == [("a", 1), ("b", 9)]
    d = spark.createDataFrame([("/x/a.jpg", T0, ["A", "B"], ["P", "2024"], "/out/a.jpg", "city")], "path string, taken_at timestamp_ntz, persons array<string>, parts array<string>, target string, reason string")
    reports.write_plan_csv(d, str(tmp_path / "p.csv"))
    raw = (tmp_path / "p.csv").read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfpath;taken_at") and b";A" in raw.replace(b'"', b"") and "2024 (1)" in reports.plan_tree_html(d)
    assert config.from_mapping({"geo": {"session_gap_hours": 2, "nope": 1}, "bad": 3}).geo.session_gap_hours == 2
    ch = reports.set_choices(spark.createDataFrame([(1, "keep", ""), (2, "keep", "")], schema.DEDUP_CHOICE), spark.createDataFrame([(1, None, ""), (3, "to_delete", "")], schema.DEDUP_CHOICE))
    assert sorted(r.file_id for r in ch.collect()) == [2, 3]


def test_geo_tables_and_exif_records(spark, tmp_path):
    (tmp_path / "p.tsv").write_text("1\t1.0\t2.0\tPPL\tRU\t1\t\tOld\t5\nx\t1\t1\tP\tRU\t\t\tbad\t1\n1\t1.5\t2.0\tPPL\tRU\t1\t\t\t5\nshort\n")
    r = source.places_tsv(spark, str(tmp_path / "p.tsv")).collect()
    assert [(x.geonameid, x.lat, x.name_en) for x in r] == [(1, 1.5, "1")]
    j = spark.createDataFrame([('[{"SourceFile":"a","DateTimeOriginal":"","CreateDate":"2020:01:01 00:00:00","GPSLatitude":"10 deg 30\' 0.00\\" S","GPSLongitude":"","Make":""}]',)], "value string")
    x = source.exif_records(j).first()
    assert (x.path, x.date_original, x.gps_lat, x.gps_lon, x.camera_make) == ("a", "2020:01:01 00:00:00", -10.5, None, None)
    asked = []
    got = source.geocode_online(spark.createDataFrame([(1.0001, 2.0), (1.0002, 2.0), (5.0, 5.0)], "lat double, lon double"), lambda a, b: asked.append((a, b)) or ({"country_code": "fr", "town": "X"} if a < 2 else {}))
    assert len(asked) == 2 and {(r.country, r.city) for r in got.collect()} == {("FR", "X"), (None, None)}


def test_streams(spark, tmp_path):
    rows = [(i, T0 + timedelta(hours=h), 1, "a", 1.0, "") for i, h in enumerate([0, 6, 13, 13])]
    spark.createDataFrame(rows + [rows[0]], streams.EVENTS).write.parquet(str(tmp_path / "in"))
    q = streams.sessions(streams.once(streams.read(spark, str(tmp_path / "in"))).withColumnRenamed("value", "v"), late="1 day")
    run = q.writeStream.format("memory").queryName("tm_sessions").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp0")).trigger(availableNow=True)
    with pytest.raises(Exception, match="(?i)unsupported|multiple|output mode"):
        run.start().awaitTermination()
    s = streams.sessions(streams.read(spark, str(tmp_path / "in")))
    s.writeStream.format("memory").queryName("tm_plain").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp1")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.n for r in spark.table("tm_plain").collect()) == [2, 3]
    up = streams.upsert_into(streams.read(spark, str(tmp_path / "in")), str(tmp_path / "t"), ["event_id"], streams.EVENTS, str(tmp_path / "cp2"))
    up.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4


def test_common_prefix_and_samples(spark):
    d = spark.createDataFrame([("/a/bc/x",), ("/a/bd/y",)], "p string")
    assert grouping.common_prefix(d, "p").first().common == "/a"
    n = spark.createDataFrame([(1, i) for i in range(10)], "k int, i int")
    assert [r.i for r in grouping.even_samples(n, ["k"], ["i"], 4).orderBy("i").collect()] == [0, 3, 6, 9]
    assert grouping.even_samples(n, ["k"], ["i"], 1).count() == 1


def test_plan_tree_has_every_folder(spark):
    d = spark.range(20_500).selectExpr("array('a', concat('f', id)) AS parts")
    page = reports.plan_tree_html(d)
    assert page.count("<summary>") == page.count("</details>") == 20_501 and "<summary>a (20500)</summary>" in page and "f9999 (1)" in page
