"""The commands, from a folder of files to moved files and back."""

from __future__ import annotations

import os

import pytest

from tidemark import cli


def test_commands(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    for k, name in enumerate(["IMG_20200101_101010.jpg", "IMG_20200101_111010.jpg", "IMG_20200101_121010.jpg", "IMG_20200101_131010.jpg", "IMG_20200101_141010.jpg", "same.jpg"]):
        (src / name).write_bytes(bytes([min(k, 4)]) * 6000)
    geo = tmp_path / "geo"
    geo.mkdir()
    (geo / "places.tsv").write_text("1\t55.7\t37.6\tPPLC\tRU\t48\t\tMoscow\t9\n")
    (geo / "names.tsv").write_text("1\tru\tМосква\n")
    (geo / "admin1.tsv").write_text("RU\t48\t5\tMoscow region\n")
    (geo / "countries.tsv").write_text("RU\t7\tRussia\n")

    def tidemark(*arguments):
        return cli.main(["--index", str(tmp_path / "index"), "--geo", str(geo), *arguments], spark)

    tidemark("index", str(src), "--no-camera")
    assert tidemark("stats").first().total == 6 and tidemark("dupes").count() == 1 and tidemark("dupes", "--near").count() == 0
    tidemark("geo")
    tidemark("phash")
    tidemark("events")
    s = cli.Store(spark, str(tmp_path / "index"))
    event = s.read("events").first()
    assert event.name == "2020-01-01" and s.read("event_files").count() == 5
    tidemark("rename-event", str(event.id), "New Year")
    tidemark("events")
    assert [r.name for r in s.read("events").collect()] == ["New Year"]
    assert tidemark("name-events") == {"total": 0, "failed": 0, "unchanged": 0, "renamed": 0, "manual_kept": 1}
    tidemark("add-event", "Noon", "2020-01-01T12:00:00", "2020-01-01T13:30:00")
    assert sorted(r.name for r in s.read("events").collect()) == ["New Year", "Noon"]
    tidemark("events")
    assert {r.name for r in s.read("events").where("origin = 'manual'").collect()} == {"Noon"}
    assert tidemark("sort", str(out), "--by", "event") is None and os.path.exists(tmp_path / "index" / "reports" / "plan_event.html")
    report = tidemark("sort", str(out), "--by", "event", "--where", "year=2020", "--apply")
    assert report.done == 5 and not (src / "IMG_20200101_101010.jpg").exists()
    assert s.read("files").where(f"path LIKE '{out}/%'").count() == 5
    assert tidemark("undo").done == 5 and (src / "IMG_20200101_101010.jpg").exists()
    tidemark("index", str(src), "--no-camera")
    assert tidemark("album", "Party", str(tmp_path / "albums"), "--event", "noon", "--apply").done == 2
    tidemark("reset", "places")
    assert s.read("places").count() == 0
    with pytest.raises(SystemExit):
        cli.main(["--index", str(tmp_path / "index"), "geo"], spark)
