"""Readers and the release audit on small documents."""

import json

from lacuna.operators import audit
from lacuna.sources import documents as d

HELD = "release_id string, seq int, path string, disc_number int, number int, title string, track_ids array<string>, recording_ids array<string>"


def release(tmp_path, spark, *media, ids=True):
    lists = [{"position": str(i), "track-list": [{"number": n, "title": t, "id": f"t{i}{n}" if ids else None, "length": "61000", "recording": {"id": f"r-{t}" if ids else None, "title": t}} for n, t in m]} for i, m in enumerate(media, 1)]
    path = tmp_path / "release.json"
    path.write_text(json.dumps([{"id": "R", "title": "Album", "medium-list": lists}]))
    return d.official_tracks(d.read_documents(spark, str(path), d.RELEASE))


def held(spark, *rows):
    return spark.createDataFrame([("R", i, f"/f{i}", *r) for i, r in enumerate(rows)], HELD)


def taken(tracks):
    return {r.seq: r.path for r in tracks.filter("not is_extra").collect()}


def test_positions_of_official_tracks(spark, tmp_path):
    rows = release(tmp_path, spark, [("1", "One"), ("2", "Two")], [("1", "Three")]).orderBy("seq").collect()
    assert [(r.disc_number, r.track_position, r.absolute_position, r.seconds) for r in rows] == [(1, 1, 1, 61.0), (1, 2, 2, 61.0), (2, 1, 3, 61.0)]
    assert all(r.alt_titles == [] for r in rows)


def test_ids_come_before_titles(spark, tmp_path):
    official = release(tmp_path, spark, [("1", "One"), ("2", "Two")])
    tracks = audit.audit_tracks(official, held(spark, (1, 1, "One", ["t12"], []), (1, 2, "Two", ["t11"], [])))
    assert taken(tracks) == {1: "/f1", 2: "/f0"}


def test_repeated_recording_goes_to_its_position(spark, tmp_path):
    official = release(tmp_path, spark, [("1", "Intro"), ("2", "Song"), ("3", "Intro")])
    tracks = audit.audit_tracks(official, held(spark, (1, 3, "Intro", [], ["r-Intro"])))
    assert taken(tracks) == {1: None, 2: None, 3: "/f0"}


def test_position_title_and_extras(spark, tmp_path):
    official = release(tmp_path, spark, [("1", "Morning Light"), ("2", "Evening Star"), ("3", "Midnight Train"), ("4", "Noon")], ids=False)
    files = held(spark, (1, 1, "Morning Lite", [], []), (None, None, "Evening Stars", [], []), (1, 9, "Midnight Trains", [], []), (1, 4, "04", [], []), (1, 8, "Bonus", [], []))
    tracks = audit.audit_tracks(official, files)
    assert taken(tracks) == {1: "/f0", 2: "/f1", 3: None, 4: "/f3"}
    assert {r.path for r in tracks.filter("is_extra").collect()} == {"/f2", "/f4"}
    assert audit.audit_releases(tracks).first().asDict() == {"release_id": "R", "expected": 4, "found": 3, "missing": 1, "extras": 2, "percent": 75.0, "status": "has_missing"}


def test_sides_and_numbering_through(spark, tmp_path):
    official = release(tmp_path, spark, [("A1", "Alpha"), ("B1", "Beta")], [("C1", "Gamma")], ids=False)
    flat = held(spark, (None, 3, None, [], []), (None, 1, "Alpha", [], []))
    assert taken(audit.audit_tracks(official, flat)) == {1: "/f1", 2: None, 3: "/f0"}
    keys = {r.seq: set(r["keys"]) for r in audit.official_positions(official).collect()}
    assert "side|B|1" in keys[2] and "medium|2|1" in keys[3] and "absolute|3" in keys[3]


def test_versions_keep_apart_and_nothing_held(spark, tmp_path):
    official = release(tmp_path, spark, [("1", "Song (Live)"), ("2", "Song")], ids=False)
    assert taken(audit.audit_tracks(official, held(spark, (None, None, "Song", [], [])))) == {1: None, 2: "/f0"}
    none = spark.createDataFrame([], HELD)
    assert audit.audit_releases(audit.audit_tracks(official, none)).first().status == "has_missing"
    wrong = audit.audit_tracks(official, held(spark, (None, None, "Other", None, None)))
    assert audit.audit_releases(wrong).first().status == "unverified"


def test_peer_files(spark):
    files = [("A\\B\\x.mp3", 5, "mp3", False, 1.0, 320, None, None), ("a\\b\\X.mp3", 5, "mp3", False, 1.0, 320, None, None), ("A\\B\\y.mp3", 6, "mp3", True, 1.0, 320, None, None)]
    found = d.peer_files(spark.createDataFrame([("q", "ann (queued)", True, 2, 10, files), ("q", "bob", None, None, None, None)], d.RESPONSE))
    assert [(r.user, r.directory, r.name) for r in found.collect()] == [("ann", "A/B", "x.mp3")]
    assert d.peer_directories(found).first().n_files == 1


def test_transfers(spark):
    def f(state, at):
        return ("1", "d\\x", 1, state, 0, None, at, "0001-01-01T00:00:00", None, None)

    rows = d.transfers(spark.createDataFrame([("u", [("d", [f("Completed, Errored, Cancelled", "2024-01-02T03:04:05.1234567Z"), f("Completed, Succeeded", None), f("Queued", "junk"), f(None, None)])])], d.DOWNLOADS)).collect()
    assert [r.failure for r in rows] == ["Cancelled", None, None, None]
    assert rows[0].last_moved.microsecond == 123456 and rows[1].last_moved is None and rows[2].last_moved is None


def test_only_changed_files_are_read(spark):
    listing = spark.createDataFrame([("a", 1.0, 5), ("b", 2.0, 5), ("c", 1.0, 5), ("d", 1.0, 5)], "path string, mtime double, size_bytes long")
    cache = spark.createDataFrame([("a", 1.0, 5, 1, 3), ("b", 1.0, 5, 1, 3), ("c", 1.0, 5, None, 3), ("d", 1.0, 5, 1, 2)], "path string, mtime double, size_bytes long, disc_number int, extractor_version int")
    assert sorted(r.path for r in d.to_read(listing, cache, 3).collect()) == ["b", "c", "d"]
