"""Keyed operators over rows that arrive in any order: a sorted buffer in state, released by the watermark.

A row waits until the watermark has passed its time, then goes on in the order (t, side, id) together with all rows of its
key that wait before it. What an operator makes of the rows thus does not depend on how they were cut into batches, and
equals what it makes of a table. A row that comes after a later one of its key went on is late: it changes nothing and
comes out as such. Timers are set at the earliest waiting row, so a silent key goes on too. Keys are dealt into slots, which
are what Spark groups by: state, timers and calls are in proportion to rows, not to calls per key.

Spark itself would drop rows behind the watermark and only count them. Here the time reaches the operator as a plain number,
so that they arrive and can be told.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.packets import LAST, SINGLE
from ..sources.banks import BATCH_ROWS, CRC_BYTES, HEAD, TELEMETRY_BANK, crc16
from ..sources.ranges import OPEN_WORD, SYNC_WORD

#: Slots into which keys are dealt; the number is part of a stream's state.
SLOTS = 1024


class InOrder(StatefulProcessor):
    """Rows of a key in order. ``fields`` is the schema of the rows behind t long, side int, id long, ``key_schema`` that of the
    key, and ``carries`` that of what is kept of a key between its rows. A subclass has ``step`` (a key, its rows in order, what
    is kept of it or None, and the watermark, to result rows and what is kept), ``late`` and, if keys are due without a row,
    ``wakes`` and ``due``; ``start`` and ``finish`` stand around the steps of a slot. All results have the key's columns and
    those of ``result``.

    Spark's key is a slot of keys: their rows wait together, under one timer, and what is kept is an entry each, so that a
    key costs a look-up and an update and not calls, frames and timers of its own."""

    fields, key_schema, carries, result = "", "", "", ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        schema = f"{self.key_schema}, t long, side int, id long" + (f", {self.fields}" if self.fields else "")
        self.names = [c.split()[0] for c in schema.split(", ")]
        self.width = len(self.key_schema.split(", "))
        self.held = handle.getListState("held", schema)
        self.carry = handle.getMapState("carry", self.key_schema, f"done_t long, done_side int, done_id long, {self.carries}")
        self.timer = handle.getValueState("timer", "at long")
        self.begin(handle)

    def begin(self, handle: StatefulProcessorHandle) -> None:
        pass

    def start(self) -> None:
        pass

    def step(self, key: tuple, rows: list[tuple], had: tuple | None, mark: int) -> tuple[list[tuple], tuple]:
        raise NotImplementedError

    def finish(self) -> None:
        pass

    def late(self, key: tuple, row: tuple) -> tuple:
        raise NotImplementedError

    def wakes(self) -> int | None:
        """Milliseconds at which some key of the slot is due even without rows."""
        return None

    def due(self, mark: int) -> list[tuple]:
        """The keys that are due without rows."""
        return []

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known: dict = {}
        new, late, n = [], [], self.width
        for chunk in rows:
            for r in chunk[self.names].itertuples(index=False, name=None):
                had = self._known(known, r[:n])
                if had is not None and r[n : n + 3] <= had[:3]:
                    late.append((*r[:n], *self.late(r[:n], r[n:])))
                else:
                    new.append(r)
        yield from self._frames(late)
        yield from self._release(known, new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._release({}, [], timerValues.getCurrentWatermarkInMs())

    def _known(self, known: dict, key: tuple) -> tuple | None:
        if key not in known:
            found = self.carry.getValue(key)
            known[key] = None if found is None else tuple(found)
        return known[key]

    def _release(self, known: dict, new: list[tuple], mark: int) -> Iterator[pd.DataFrame]:
        n = self.width
        held = [tuple(r) for r in self.held.get()] if self.held.exists() else []
        ready = sorted((r for r in held + new if r[n] // 1000 <= mark), key=lambda r: ([(v is not None, v) for v in r[:n]], r[n : n + 3]))
        rest = [r for r in held + new if r[n] // 1000 > mark]
        wakes = self.wakes()
        if ready or (wakes is not None and wakes <= mark):
            self.start()
            out, seen = [], set()
            for key, some in itertools.groupby(ready, lambda r: r[:n]):
                out += self._step(known, key, [r[n:] for r in some], mark)
                seen.add(key)
            for key in self.due(mark):
                if key not in seen:
                    out += self._step(known, key, [], mark)
            self.finish()
            yield from self._frames(out)
        if len(rest) != len(held) + len(new) and held:
            self.held.clear()
            if rest:
                self.held.put(rest)
        elif [r for r in new if r[n] // 1000 > mark]:
            self.held.appendList([r for r in new if r[n] // 1000 > mark])
        due = ([min(r[n] for r in rest) // 1000] if rest else []) + [w for w in [self.wakes()] if w is not None]
        self._set_timer(max(mark + 1, min(due)) if due else None)

    def _step(self, known: dict, key: tuple, rows: list[tuple], mark: int) -> list[tuple]:
        had = self._known(known, key)
        out, keeps = self.step(key, rows, None if had is None else had[3:], mark)
        done = rows[-1][:3] if rows else had[:3]
        self.carry.updateValue(key, (*done, *keeps))
        return [(*key, *r) for r in out]

    def _frames(self, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        columns = [c.split() for c in f"{self.key_schema}, {self.result}".split(", ")]
        for lo in range(0, len(rows), BATCH_ROWS):
            values = zip(*rows[lo : lo + BATCH_ROWS], strict=True)
            yield pd.DataFrame({c: pd.array(v, "Int64") if kind in ("long", "int") else pd.Series(v, dtype=object) for (c, kind), v in zip(columns, values, strict=True)})

    def _set_timer(self, at: int | None) -> None:
        had = self.timer.get()[0] if self.timer.exists() else None
        if had == at:
            return
        if had is not None:
            self.handle.deleteTimer(had)
        if at is None:
            self.timer.clear()
        else:
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def close(self) -> None:
        pass


def slot(keys: list[str]) -> Column:
    """The slot of a key, by which Spark groups."""
    return F.pmod(F.xxhash64(*keys), F.lit(SLOTS))


def in_order(rows: DataFrame, keys: list[str], at: str, delay: str, processor: InOrder, side: Column | None = None, order: str = "id") -> DataFrame:
    """Run ``processor`` over a stream of rows with the timestamp ``at``; t is in microseconds. Needs the RocksDB store."""
    marked = rows.withWatermark(at, delay)
    names = [c.split()[0] for c in processor.fields.split(", ")] if processor.fields else []
    plain = marked.select(slot(keys).alias("_slot"), *keys, F.unix_micros(at).alias("t"), (side if side is not None else F.lit(0)).cast("int").alias("side"), F.col(order).cast("long").alias("id"), *names)
    return plain.groupBy("_slot").transformWithStateInPandas(processor, f"{processor.key_schema}, {processor.result}", "append", "EventTime")


class Sessions(InOrder):
    """Number the sessions of each stream from 0: a hello after a row that is none starts one."""

    fields, key_schema, carries, result = "hello boolean", "stream string", "number long, hello boolean", "t long, id long, hello boolean, session_no long, late boolean"

    def step(self, key: tuple, rows: list[tuple], had: tuple | None, mark: int) -> tuple[list[tuple], tuple]:
        number, before = had or (0, True)
        out = []
        for t, _, i, hello in rows:
            number, before = number + int(bool(hello) and not before), bool(hello)
            out.append((t, i, before, number, False))
        return out, (number, before)

    def late(self, key: tuple, row: tuple) -> tuple:
        return row[0], row[2], row[3], None, True


class AsOf(InOrder):
    """Telemetry (side 1) with the latest session start (side 0, whose id is the session) at or before it; what comes before
    the first start waits for it and goes to it. A session start that is late is told with no telemetry."""

    fields, key_schema, carries, result = "", "stream string", "latest long", "t long, side int, id long, session long, late boolean"

    def begin(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getListState("waiting", "stream string, t long, id long")

    def start(self) -> None:
        self.early, self.waited = [], None

    def step(self, key: tuple, rows: list[tuple], had: tuple | None, mark: int) -> tuple[list[tuple], tuple]:
        latest = had[0] if had else None
        out, early = [], []
        for t, side, i in rows:
            if side == 0:
                if latest is None:
                    if had and self.waited is None:
                        self.waited = {}
                        for stream, *place in self.waiting.get() if self.waiting.exists() else ():
                            self.waited.setdefault(stream, []).append(tuple(place))
                    early = (self.waited.pop(key[0], []) if had else []) + early
                    out += [(a, 1, b, i, False) for a, b in early]
                    early = []
                latest = i
            elif latest is None:
                early.append((t, i))
            else:
                out.append((t, 1, i, latest, False))
        self.early += [(*key, *e) for e in early]
        return out, (latest,)

    def finish(self) -> None:
        if self.waited is None:
            if self.early:
                self.waiting.appendList(self.early)
            return
        left = [(k, *e) for k, some in self.waited.items() for e in some] + self.early
        self.waiting.clear()
        if left:
            self.waiting.put(left)

    def late(self, key: tuple, row: tuple) -> tuple:
        return *row[:3], None, True


class Downlink(InOrder):
    """Frames of all banks of a stream to packets with identities and session numbers, and rejects with their reasons.

    Frames of a bank join until one closes the packet; science payloads are swapped in 16-bit pairs, and an odd one drops what
    was gathered before it, itself included. A group to which nothing was added for ``ttl_s`` seconds of event time expires as
    ``open``. ``classes`` tells for ids of packets whether they are ``derived`` (they take the latest unique id before them)
    or ``dropped``; others have it in their first four bytes. A packet whose id is in ``hellos`` starts a session unless the
    packet before it is one too.
    """

    fields, key_schema, carries = "bank string, appid int, groupflags int, sequence_cnt int, payload binary", "stream_id string", "uid long, number long, hello boolean"
    result = "kind string, reason string, bank string, t long, pkt_idx long, appid int, start_seq int, seq int, unique_packet_id long, session_no long, blob binary"

    def __init__(self, ttl_s: float, classes: dict[int, str], hellos: set[int]):
        self.ttl, self.classes, self.hellos = int(ttl_s * 1_000_000), classes, hellos

    def begin(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getListState("open", "stream_id string, bank string, t long, id long, appid int, sequence_cnt int, payload binary")
        self.expires = handle.getValueState("expires", "at long")

    def wakes(self) -> int | None:
        return self.expires.get()[0] if self.expires.exists() else None

    def start(self) -> None:
        self.groups: dict[tuple, dict[str, list[tuple]]] = {}
        for stream, bank, *frame in self.open.get() if self.open.exists() else ():
            self.groups.setdefault((stream,), {}).setdefault(bank, []).append(tuple(frame))

    def due(self, mark: int) -> list[tuple]:
        return [k for k, groups in self.groups.items() if any(g and (g[-1][0] + self.ttl) // 1000 < mark for g in groups.values())]

    def step(self, key: tuple, rows: list[tuple], had: tuple | None, mark: int) -> tuple[list[tuple], tuple]:
        groups = self.groups.setdefault(key, {})
        uid, number, was = had or (None, 0, True)
        out: list[tuple] = []

        def reject(reason: str, bank: str, frame: tuple) -> None:
            out.append(("reject", reason, bank, frame[0], frame[1], frame[2], frame[3], None, None, None, None))

        for t, _, i, bank, appid, groupflags, sequence_cnt, payload in rows:
            group = groups.setdefault(bank, [])
            if group and t - group[-1][0] > self.ttl:
                reject("open", bank, group[0])
                group.clear()
            payload, frame = bytes(payload), (t, i, appid, sequence_cnt)
            if bank != TELEMETRY_BANK and len(payload) % 2:
                reject("odd", bank, frame)
                group.clear()
                continue
            if bank != TELEMETRY_BANK:
                payload = np.frombuffer(payload, "<u2").byteswap().tobytes()
            group.append((*frame, payload))
            if groupflags not in (LAST, SINGLE):
                continue
            first, blob, kind = group[0], b"".join(bytes(f[4]) for f in group), self.classes.get(group[0][2])
            group.clear()
            if kind == "dropped":
                continue
            own = int.from_bytes(blob[:4], "little") if len(blob) >= 4 and kind != "derived" else None
            if own is None and (kind != "derived" or uid is None):
                reject("no uid", bank, (t, first[1], first[2], first[3]))
                continue
            uid = own if own is not None else uid
            hello = first[2] in self.hellos
            number, was = number + int(hello and not was), hello
            out.append(("packet", None, bank, t, first[1], first[2], first[3], sequence_cnt, uid, number, blob))
        for bank, group in groups.items():
            if group and (group[-1][0] + self.ttl) // 1000 < mark:
                reject("open", bank, group[0])
                group.clear()
        return out, (uid, number, was)

    def finish(self) -> None:
        left = [(*key, bank, *f) for key, groups in self.groups.items() for bank, group in groups.items() for f in group]
        self.open.clear()
        if left:
            self.open.put(left)
            self.expires.update((min((g[-1][0] + self.ttl) // 1000 for groups in self.groups.values() for g in groups.values() if g) + 1,))
        else:
            self.expires.clear()
        self.groups = {}

    def late(self, key: tuple, row: tuple) -> tuple:
        t, _, i, bank, appid, _, sequence_cnt, _ = row
        return "reject", "late", bank, t, i, appid, sequence_cnt, None, None, None, None


def sessions_in_order(rows: DataFrame, at: str = "at", delay: str = "10 minutes") -> DataFrame:
    """stream, t, id, hello, session_no, late of a stream of (stream, at, id, hello) in any order within ``delay``."""
    return in_order(rows, ["stream"], at, delay, Sessions())


def asof_in_order(telemetry: DataFrame, starts: DataFrame, at: str = "at", delay: str = "10 minutes") -> DataFrame:
    """stream, t, side, id, session, late: both inputs are streams of (stream, at, id); a start's id names its session."""
    both = starts.select("stream", at, "id", F.lit(0).alias("_side")).unionByName(telemetry.select("stream", at, "id", F.lit(1).alias("_side")))
    return in_order(both, ["stream"], at, delay, AsOf(), F.col("_side"))


def downlink(frames: DataFrame, ttl_s: float, classes: dict[int, str] | None = None, hellos: set[int] | None = None, at: str = "at", delay: str = "10 minutes") -> DataFrame:
    """Packets with identities and session numbers, and rejects, of a stream of frames (stream_id, at, id, bank, appid,
    groupflags, sequence_cnt, payload): kind tells them apart."""
    return in_order(frames, ["stream_id"], at, delay, Downlink(ttl_s, classes or {}, hellos or set()))


class _Cutter(StatefulProcessor):
    """Frames of the banks of a slot that grow: what does not make a frame yet stays in state, an entry a bank."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rest = handle.getMapState("rest", "stream_id string, bank string", "frames long, content binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = ["stream_id", "bank", "frame_idx", "head", "payload", "reject"]
        chunks = [r for chunk in rows for r in chunk[["stream_id", "bank", "at", "content"]].itertuples(index=False, name=None)]
        out = []
        for bank, some in itertools.groupby(sorted(chunks, key=lambda r: r[:3]), lambda r: r[:2]):
            n, rest = self.rest.getValue(bank) or (0, b"")
            rest = bytes(rest)
            for *_, content in some:
                data, at = rest + bytes(content), 0
                while found := SYNC_WORD.search(data, at):
                    head = data[found.end() : found.end() + HEAD]
                    size = int.from_bytes(head[4:6], "big") + 1 + CRC_BYTES if len(head) == HEAD else 0
                    body = data[found.end() + HEAD : found.end() + HEAD + size]
                    if len(head) < HEAD or len(body) < size:
                        break
                    good = crc16(head + body[:-CRC_BYTES]) == int.from_bytes(body[-CRC_BYTES:], "big")
                    out.append((*bank, n, head, body[:-CRC_BYTES], None if good else "crc"))
                    n, at = n + 1, found.end() + HEAD + size
                cut = found or OPEN_WORD.search(data, at)
                rest = data[cut.start() :] if cut else b""
            self.rest.updateValue(bank, (n, rest))
            if len(out) >= BATCH_ROWS:
                yield pd.DataFrame(out, columns=names)
                out = []
        yield pd.DataFrame(out, columns=names)

    def close(self) -> None:
        pass


def growing_frames(chunks: DataFrame) -> DataFrame:
    """stream_id, bank, frame_idx, head, payload, reject of a stream of bytes as ``bank_bytes`` and ``packed_bytes`` give it:
    frames of banks that are still being written, numbered through. A batch of a slot of banks is held by one task; read what
    is there already with ``range_frames`` if it is much."""
    keys = ["stream_id", "bank"]
    return chunks.withColumn("_slot", slot(keys)).groupBy("_slot").transformWithStateInPandas(_Cutter(), "stream_id string, bank string, frame_idx long, head binary, payload binary, reject string", "append", "none")
