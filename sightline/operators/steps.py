"""The order-dependent rules of a stream, one Step each; batch (ordered_scan) and streaming (sightline.streaming) run the same classes."""

from __future__ import annotations

from dataclasses import dataclass, field

from sightline.operators.fold import Step


@dataclass
class Throttle(Step):
    """Frame-rate limit of the pipeline: a row (t, has_image) is kept if it is min_dt or more after the last kept one. The first row, a jump back and one of over 10 s always count as late enough."""

    min_dt: float
    last: float | None = None

    def push(self, row):
        t = row["t"]
        if self.last is None or t < self.last or t > self.last + 10.0:
            self.last = t - 10.0
        kept = t - self.last + 1e-7 >= self.min_dt and row.get("has_image", True)
        if kept:
            self.last = t
        yield {**row, "kept": kept}


@dataclass
class DecoderThrottle(Step):
    """Frame-rate limit of the decoder: skips rows less than min_dt after the last output; a jump back or of over 10 s is output and resets the clock."""

    min_dt: float
    last: float = 0.0

    def push(self, row):
        gap = row["t"] - self.last
        kept = not (0 <= gap <= 10.0 and gap < self.min_dt)
        if kept:
            self.last = row["t"]
        yield {**row, "kept": kept}


@dataclass
class MotionSkip(Step):
    """Skips a row whose motion area is below a threshold: the lower one after a skip, the higher after a row that ran."""

    after_skip: float = 0.01
    after_run: float = 0.05
    skipped: bool = False

    def push(self, row):
        self.skipped = row["area"] < (self.after_skip if self.skipped else self.after_run)
        yield {**row, "skipped": self.skipped}


@dataclass
class LoadShed(Step):
    """Drops rows by phase of eight as the smoothed queue length grows (fast up, slow down)."""

    level: float = 0.0
    count: int = 0

    #: Phases dropped above each load.
    PHASES = ((0.125, (7,)), (0.25, (3,)), (0.5, (1, 5)), (0.75, (2, 6)), (0.875, (4,)))

    def push(self, row):
        gap = row["queue"] - self.level
        self.level += (0.3 if gap > 0 else 0.1) * gap
        self.count += 1
        load = min(0.95, self.level)
        yield {**row, "load": load, "dropped": any(load > at and self.count % 8 in phases for at, phases in self.PHASES)}


@dataclass
class Snapshot(Step):
    """When a stream's main picture (every 5 s at most) and, with a picture only, its embedding (every 2 s at most) are due."""

    picture_s: float = 5.0
    embedding_s: float = 2.0
    picture: float = 0.0
    embedding: float = 0.0

    def push(self, row):
        due = row["t"] - self.picture >= self.picture_s
        embed = due and row["t"] - self.embedding >= self.embedding_s
        if due:
            self.picture = row["t"]
        if embed:
            self.embedding = row["t"]
        yield {**row, "picture": due, "embedded": embed}


@dataclass
class BestShot(Step):
    """Keyed by track: takes a new shot if its quality q clears a bar over the last one taken; every later row refers to it."""

    least: float = 0.0
    times: float = 1.2
    more: float = 0.02
    least_pixels: int = 32
    best: float = 0.0
    best_frame: int | None = None

    def push(self, row):
        bar = max(self.times * self.best, self.best + self.more) if self.best > 0 else 0.0
        large = row.get("width", self.least_pixels) >= self.least_pixels and row.get("height", self.least_pixels) >= self.least_pixels
        taken = large and row["q"] > max(self.least, bar)
        if taken:
            self.best, self.best_frame = row["q"], row["frame_no"]
        yield {**row, "taken": taken, "best": self.best, "best_frame": self.best_frame}


@dataclass
class RunningMean(Step):
    """A mean whose rate starts at 1 and falls by 5 % a sample to 0.01."""

    mean: float = 0.0
    rate: float = 1.0

    def push(self, row):
        self.mean += self.rate * (row["v"] - self.mean)
        self.rate = max(0.01, self.rate * 0.95)
        yield {**row, "mean": self.mean}


@dataclass
class NoiseFloor(Step):
    """Keyed by block: a floor that falls fast (alpha, ramped up over the first frames) and rises slowly (beta); motion is a value far over it."""

    over: float = 24.0
    alpha: float = 0.9
    beta: float = 0.995
    ramp: int = 16
    floor: float = 0.0
    n: int = 0

    def push(self, row):
        v = row["v"]
        alpha = self.alpha * min(self.n, self.ramp) / self.ramp
        k = alpha if v < self.floor else self.beta
        self.floor = self.floor * k + v * (1 - k)
        self.n += 1
        yield {**row, "floor": self.floor, "motion": v > self.floor + self.over}


@dataclass
class SourceSwitch(Step):
    """Packets of another source (ssrc) are dropped until its fourth as candidate; packets of the current source don't clear the count."""

    needed: int = 4
    current: int | None = None
    candidate: int | None = 0
    count: int = 0

    def push(self, row):
        ssrc, ok = row["ssrc"], True
        if self.current is None:
            self.current = ssrc
        elif ssrc != self.current:
            if ssrc == self.candidate:
                self.count += 1
            else:
                self.candidate, self.count = ssrc, 1
            ok = self.count >= self.needed
            if ok:
                self.current, self.count = ssrc, 0
        yield {**row, "accepted": ok}


def _signed(x: int, bits: int) -> int:
    half = 1 << bits - 1
    return (x + half) % (1 << bits) - half


@dataclass
class Reorder(Step):
    """A packet reorder buffer: rows in arrival order (seq16, ts32) come out in sequence order.

    A gap is given up when `ahead` later packets wait, or one of them is more
    than late_ms after the last output by its timestamp. Packets before the last
    output are late. Output rows have n (place), seq16 and ts64; a row with
    event 'late', 'duplicate', 'missing' or 'reset' counts what happened.
    """

    window: int = 32
    ahead: int = 4
    late_ms: int = 200
    clock: int = 90_000
    last: int | None = None
    outside: int = 0
    held: dict = field(default_factory=dict)  # by slot
    last32: int = 0
    last64: int | None = None
    n: int = 0

    def push(self, row):
        seq = row["seq16"]
        if self.last is not None:
            gap = _signed(seq - self.last, 16)
            if abs(gap) > self.window:
                yield {"event": "outside", "seq16": seq}
                self.outside += 1
                if self.outside > 4:
                    self.last = (seq - 1) % 65536
                    yield {"event": "reset", "seq16": seq}
            else:
                self.outside = 0
            if gap < 0:
                yield {"event": "late", "seq16": seq}
                return
        slot = seq % self.window
        if slot in self.held and self.held[slot]["seq16"] == seq:
            yield {"event": "duplicate", "seq16": seq}
        self.held[slot] = row
        if self.last is None:
            self.last = (seq - 1) % 65536
        yield from self._flush()

    def _flush(self):
        while True:
            nxt = (self.last + 1) % 65536
            row = self.held.get(nxt % self.window)
            if row is not None and row["seq16"] == nxt:
                del self.held[nxt % self.window]
                self.last = nxt
                ts = row["ts32"]
                self.last64 = ts if self.last64 is None else self.last64 + _signed(ts - self.last32, 32)
                self.last32 = ts
                self.n += 1
                yield {**row, "event": "out", "n": self.n, "ts64": self.last64}
                continue
            waiting = 0
            for k in range(1, self.window):
                s = (nxt + k) % 65536
                other = self.held.get(s % self.window)
                if other is not None and other["seq16"] == s:
                    waiting += 1
                    if waiting >= self.ahead or _signed(other["ts32"] - self.last32, 32) > self.clock * self.late_ms // 1000:
                        break
            else:
                return
            self.last = nxt
            yield {"event": "missing", "seq16": nxt}


#: What a receiver gives for each access unit.
RECEIVED = "au_no long, ts64 long, key boolean, n_nals int, n_packets int, errors int, complete boolean, data binary"


@dataclass
class RtpReceiver(Step):
    """The way of a stream's packets (ssrc, seq16, ts32, marker, payload; in arrival order) to access units.

    Packets of another source are held off (SourceSwitch), the rest put in order
    (Reorder). A new timestamp closes the unit before it, and a marker closes a
    unit that has video. reset() forgets all but what was counted.
    """

    codec: str = "h264"
    units: int = 0
    packets: list = field(default_factory=list)
    broken: bool = False

    def __post_init__(self):
        self.reset()

    def reset(self):
        self.source, self.buffer, self.packets, self.broken = SourceSwitch(), Reorder(), [], False

    def push(self, row):
        if next(iter(self.source.push(row)))["accepted"]:
            yield from self._ordered(self.buffer.push(row))

    def _ordered(self, rows):
        for r in rows:
            if r["event"] == "missing":
                self.broken = True
            if r["event"] != "out":
                continue
            if self.packets and self.packets[-1]["ts64"] != r["ts64"]:
                yield from self._closed()
            self.packets.append(r)
            if r["marker"] and self._has_video():
                yield from self._closed()

    def _has_video(self) -> bool:
        from sightline.sources import media

        nals, _ = media.depacketized(self.codec, [p["payload"] for p in self.packets])
        return any(media.nal_class(self.codec, media.nal_type(self.codec, x)) in ("video", "key") for x in nals)

    def _closed(self):
        from sightline.sources import media

        nals, errors = media.depacketized(self.codec, [p["payload"] for p in self.packets])
        self.units += 1
        kinds = {media.nal_class(self.codec, media.nal_type(self.codec, x)) for x in nals}
        yield {
            "au_no": self.units, "ts64": self.packets[0]["ts64"], "key": "key" in kinds, "n_nals": len(nals), "n_packets": len(self.packets), "errors": errors,
            "complete": not self.broken and not errors, "data": b"".join(b"\0\0\0\1" + x for x in nals),
        }
        self.packets, self.broken = [], False

    def end(self):
        if self.packets:
            yield from self._closed()


@dataclass
class UnitChunker(Step):
    """Access units of an Annex-B stream from its chunks (data): a start code or a unit may cross chunks."""

    codec: str
    fps: float = 30.0
    rest: bytes = b""
    nals: list = field(default_factory=list)
    has_video: bool = False
    units: int = 0

    def push(self, row):
        self.rest += row["data"]
        while (first := self.rest.find(b"\0\0\1")) >= 0 and (after := self.rest.find(b"\0\0\1", first + 3)) >= 0:
            nal, self.rest = self.rest[first + 3 : after].rstrip(b"\0"), self.rest[after:]
            yield from self._taken(nal)

    def _taken(self, nal: bytes):
        from sightline.sources import media

        if not nal:
            return
        video = media.nal_class(self.codec, media.nal_type(self.codec, nal)) in ("video", "key")
        if video and self.has_video and media.first_slice(self.codec, nal):
            yield self._unit()
        self.nals.append(nal)
        self.has_video |= video

    def _unit(self) -> dict:
        from sightline.sources import media

        (out,) = media.units_of(self.codec, self.nals, self.fps)
        out |= {"au_no": self.units, "ts90k": round(90_000 / (self.fps or 30.0) * self.units)}
        self.units, self.nals, self.has_video = self.units + 1, [], False
        return out

    def end(self):
        if (first := self.rest.find(b"\0\0\1")) >= 0:
            yield from self._taken(self.rest[first + 3 :])
        if self.nals:
            yield self._unit()


@dataclass
class FrameHash(Step):
    """Hashes of a stream's frames (h) folded in order, modulo 2**64; the total leaves as text, since it has 64 bits without a sign."""

    total: int = 0

    def push(self, row):
        from sightline.functions.pixels import frame_hash

        self.total = frame_hash(self.total, row["h"])
        yield {**row, "total": str(self.total)}
