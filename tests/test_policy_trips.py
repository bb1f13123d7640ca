"""A batch reads and writes a peer's block once, however many events it has."""

from datetime import datetime, timedelta, timezone

from pyspark.sql import Row

from lacuna.streaming.policy import PeerBlocks


class Held:
    def __init__(self):
        self.value, self.calls = None, 0

    def exists(self):
        self.calls += 1
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def clear(self):
        self.calls += 1
        self.value = None


class Seen(dict):
    containsKey, getValue, updateValue, removeKey, iterator = dict.__contains__, dict.__getitem__, dict.__setitem__, dict.pop, dict.items


class Handle:
    def __init__(self):
        self.block, self.timers = Held(), []

    def getValueState(self, *how):
        return self.block

    def getMapState(self, *how):
        return Seen()

    def registerTimer(self, at):
        self.timers.append(at)


def test_a_batch_reads_and_writes_the_block_once():
    handle, peer = Handle(), PeerBlocks()
    peer.init(handle)
    start = datetime(2026, 1, 1, tzinfo=timezone.utc)
    events = [Row(seen_at=start + timedelta(seconds=i), kind="failure", transfer_id=str(i), signature=str(i), cancelled=False, outcome="cooldown", reason="Rejected", ended=None, protected=False, bulk=False) for i in range(50)]
    rows = list(peer.handleInputRows(("p",), iter(events), None))
    end = events[-1].seen_at.timestamp() + peer.cooldown_s
    assert [r.expires_at for r in rows] == [end] and handle.block.value[2] == end and int(end * 1000) in handle.timers
    assert handle.block.calls <= 3
    assert [r.reason for r in peer.handleExpiredTimer(("p",), None, Row(getExpiryTimeInMs=lambda: int(end * 1000)))] == [None] and handle.block.value is None
