"""Songs of folders take turns only where a file serves several of them."""

from lacuna.operators import allocation

OFFERS = "release string, song long, song_order long, peer string, folder string, file long, rank long, context int, preferred boolean, placed boolean, health long, quality long"


def offer(song, folder, file, rank, quality=1):
    return ("r", song, song, "p", folder, file, rank, 0, False, False, 0, quality)


def test_only_folders_with_shared_files_take_turns(spark, monkeypatch):
    asked, allocate = [], allocation.allocate

    def told(offers, *how):
        asked.extend((r.folder, r.song, r.file) for r in offers.collect())
        return allocate(offers, *how)

    monkeypatch.setattr(allocation, "allocate", told)
    free = [offer(1, "a", 10, 2), offer(1, "a", 11, 1), offer(2, "a", 12, 1), offer(3, "a", None, 1)]
    shared = [offer(1, "b", 20, 1), offer(2, "b", 20, 1), offer(2, "b", 21, 2), offer(3, "b", 22, 1)]
    found = lambda rows: sorted((r.song, r.folder, r.file) for r in allocation.best_folders(spark.createDataFrame(rows, OFFERS)).collect())
    assert found(free) == [(1, "a", 11), (2, "a", 12)] and asked == []
    assert found(free + shared) == [(1, "b", 20), (2, "b", 21), (3, "b", 22)]
    assert sorted(asked) == [("b", 1, 20), ("b", 2, 20), ("b", 2, 21), ("b", 3, 22)]
