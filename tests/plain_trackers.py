"""Both trackers again, in plain Python and from their rules alone, for tests: lists and loops, 64-bit floats."""

import itertools
import math

# a Kalman filter as eight numbers and an 8 x 8 list


def times(a, b):
    return [[sum(x * y for x, y in zip(row, col, strict=True)) for col in zip(*b, strict=True)] for row in a]


def turned(a):
    return [list(r) for r in zip(*a, strict=True)]


def solved(a, b):
    """x with a x = b, by elimination."""
    n = len(a)
    m = [list(map(float, a[i])) + list(map(float, b[i])) for i in range(n)]
    for i in range(n):
        p = max(range(i, n), key=lambda r: abs(m[r][i]))
        m[i], m[p] = m[p], m[i]
        m[i] = [x / m[i][i] for x in m[i]]
        for r in range(n):
            if r != i:
                m[r] = [x - m[r][i] * y for x, y in zip(m[r], m[i], strict=True)]
    return [row[n:] for row in m]


def xyah(b):
    return [(b[0] + b[2]) / 2, (b[1] + b[3]) / 2, (b[2] - b[0]) / (b[3] - b[1]), b[3] - b[1]]


def corners(m):
    w = m[2] * m[3]
    return [m[0] - w / 2, m[1] - m[3] / 2, m[0] + w / 2, m[1] + m[3] / 2]


class Filter:
    def __init__(self, box):
        z = xyah(box)
        s = [2 * z[3] / 20, 2 * z[3] / 20, 1e-2, 2 * z[3] / 20, 10 * z[3] / 160, 10 * z[3] / 160, 1e-5, 10 * z[3] / 160]
        self.x, self.p = z + [0.0] * 4, [[s[i] ** 2 if i == j else 0.0 for j in range(8)] for i in range(8)]

    def moved(self, dt):
        f = [[1.0 if i == j else dt if j == i + 4 else 0.0 for j in range(8)] for i in range(8)]
        h = abs(self.x[3])
        s = [h / 20, h / 20, 1e-2, h / 20, h / 160, h / 160, 1e-5, h / 160]
        p = times(times(f, self.p), turned(f))
        return [r[0] for r in times(f, [[v] for v in self.x])], [[p[i][j] + (s[i] ** 2 if i == j else 0.0) for j in range(8)] for i in range(8)]

    def meet(self, x, p, box):
        h = abs(x[3])
        noise = [h / 20, h / 20, 1e-1, h / 20]
        seen = [[p[i][j] + (noise[i] ** 2 if i == j else 0.0) for j in range(4)] for i in range(4)]
        gain = turned(solved(seen, [p[i] for i in range(4)]))
        gap = [[a - b] for a, b in zip(xyah(box), x[:4], strict=True)]
        self.x = [a + b[0] for a, b in zip(x, times(gain, gap), strict=True)]
        less = times(times(gain, seen), turned(gain))
        self.p = [[p[i][j] - less[i][j] for j in range(8)] for i in range(8)]


def size(b):
    return (b[2] - b[0]) * (b[3] - b[1])


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w < 0 or h < 0:
        return 0.0
    whole = size(a) + size(b) - w * h
    return w * h / whole if whole > 0 else 0.0


def grid(b):
    """The cells of 8 x 8 that a box covers, clipped to the picture."""
    if not (b[2] > b[0] and b[3] > b[1] and b[0] < 1 and b[1] < 1 and b[2] > 0 and b[3] > 0):
        return set()
    span = lambda lo, hi: range(min(7, math.floor(max(lo, 0) * 8)), max(0, math.ceil(min(hi, 1) * 8) - 1) + 1)
    return {(r, c) for r in span(b[1], b[3]) for c in span(b[0], b[2])}


def one_to_one(scores):
    """Greedy: for each row in turn its pairs from the best on, each taken unless a side is taken."""
    taken_a, taken_b, out = set(), set(), []
    for a, s, b in sorted(((a, s, b) for (a, b), s in scores.items() if s > 0), key=lambda z: (z[0] - z[1], z[0], z[2])):
        if a not in taken_a and b not in taken_b:
            taken_a.add(a), taken_b.add(b), out.append((a, b))
    return out


class Cascade:
    """Three greedy passes; rows (track id, state, det id or None, observations, missed) of each frame."""

    def __init__(self):
        self.tracks, self.next = [], 0xBEEF0000

    def searched(self, t, roi):
        """The search region of a frame; predicts."""
        boxes = [list(roi)]
        for k in self.tracks:
            self._predict(k, t)
            boxes += [k["box"], k["kalman"], k["flow"]]
        lo = [min(b[i] for b in boxes) for i in (0, 1)]
        hi = [max(b[i] for b in boxes) for i in (2, 3)]
        more = [0.05 * 0.5 * max(0.05, b - a) for a, b in zip(lo, hi, strict=True)]
        clip = lambda x: min(1.0, max(0.0, x))
        return [clip(lo[0] - more[0]), clip(lo[1] - more[1]), clip(hi[0] + more[0]), clip(hi[1] + more[1])]

    def _predict(self, k, t):
        f = k["filter"]
        f.x, f.p = f.moved((t - k["updated"]) * 7.5)
        k["kalman"], k["flow"], k["at"] = corners(f.x), list(k["box"]), t
        for x, y in k["points"]:
            k["flow"] = [min(k["flow"][0], x), min(k["flow"][1], y), max(k["flow"][2], x), max(k["flow"][3], y)]

    def frame(self, t, dets):
        seen = []
        for d in dets:
            if d["cl"] == 0:
                box, points = [d["x0"], d["y0"], d["x1"], d["y1"]], []
                for q in d.get("pose_points") or ():
                    if q["conf"] > 0.05:
                        points.append((q["x"], q["y"]))
                        box = [min(box[0], q["x"]), min(box[1], q["y"]), max(box[2], q["x"]), max(box[3], q["y"])]
                sure = d["conf"] + 0.004 * sum(q["conf"] for q in d.get("pose_points") or ())
                seen.append({"box": box, "conf": d["conf"], "sure": sure, "det": d["det_id"], "reid": list(d.get("reid") or [0.0]), "points": points, "id": None, "state": "new", "n": 1, "missed": 0})
        seen.sort(key=lambda d: (-d["sure"], d["det"]))
        old = list(self.tracks)
        for k in old:
            if k.get("at") != t:
                self._predict(k, t)
            around = [f(x) for f, x in zip((min, min, max, max), zip(k["box"], k["flow"], k["kalman"], strict=True), strict=True)]
            w, h = (around[2] - around[0]) * 0.05, (around[3] - around[1]) * 0.05
            k["reach"] = [around[0] - w, around[1] - h, around[2] + w, around[3] + h]
        both = seen + old
        if both:
            mean = [sum(c) / (len(both) + 1e-7) for c in zip(*(k["reid"] for k in both), strict=True)]
            for k in both:
                v = [a - m for a, m in zip(k["reid"], mean, strict=True)]
                n = math.sqrt(sum(x * x for x in v))
                k["unit"] = [x / n for x in v] if n > 0 else v

        def score(d, k, least):
            w, h = min(d["box"][2], k["reach"][2]) - max(d["box"][0], k["reach"][0]), min(d["box"][3], k["reach"][3]) - max(d["box"][1], k["reach"][1])
            if not (w * h > 0 and grid(d["box"]) & grid(k["reach"])):
                return 0.0
            weight = 0.0 if k["n"] < 2 else 1 - max(0.1, 1 / k["n"]) ** 0.7
            s = (iou(d["box"], k["flow"]) + weight * iou(d["box"], k["kalman"])) / (1 + weight) + 0.2 * sum(a * b for a, b in zip(d["unit"], k["unit"], strict=True))
            return s * d["conf"] ** 0.94 if s >= least else 0.0

        out, used = [], set()
        for n, (sure, least) in enumerate(((0.495, 0.66), (0.9, 0.225), (0.115, 0.022))):
            free = [d for d in seen if d["id"] is None and d["sure"] > sure]
            live = [k for k in old if id(k) not in used and (n > 0 or k["state"] != "lost")]
            for a, b in one_to_one({(i, j): score(d, k, least) for i, d in enumerate(free) for j, k in enumerate(live)}):
                d, k = free[a], live[b]
                d.update(id=k["id"], n=k["n"] + 1, seen=t, filter=k["filter"], reid=[(x + y) / 2 for x, y in zip(d["reid"], k["reid"], strict=True)])
                f = d["filter"]
                f.meet(*f.moved((t - k["updated"]) * 7.5), d["box"])
                d["updated"] = t
                d["state"] = "tracked" if n < 2 or k["state"] == "lost" else k["state"]
                used.add(id(k))
                out.append(d)
        for d in seen:
            if d["id"] is None and d["sure"] > 0.57:
                d.update(id=self.next, filter=Filter(d["box"]), updated=t, seen=t, state="tracked" if d["sure"] > 1.18 else "new")
                self.next += 1
                out.append(d)
        for k in old:
            if id(k) not in used:
                k["missed"] += 1
                if ((t - k["seen"] < 2.0 and k["missed"] < 10) or k["state"] == "tracked") and len(out) < 350:
                    out.append(k)
        for k in out:
            if k["state"] == "tracked" and k["missed"] >= 2:
                k["state"] = "lost"
        sure, lost = [k for k in out if k["state"] == "tracked"], [k for k in out if k["state"] == "lost"]
        alike = {(i, j): iou(a["box"], b["box"]) for i, a in enumerate(sure) for j, b in enumerate(lost)}
        gone = {id(lost[b]) for _, b in one_to_one({ij: s for ij, s in alike.items() if s >= 0.82})}
        self.tracks = [k for k in out if id(k) not in gone]
        return [(k["id"], k["state"], k["det"] if k["seen"] == t else None, k["n"], k["missed"]) for k in self.tracks]


def best_pairs(cost, limit):
    """Pairs of least total cost, where what stays alone costs half the limit: all ways of a small problem are tried."""
    n, m = len(cost), len(cost[0]) if cost else 0
    memo = {}

    def go(i, free):
        if i == n:
            return (len(free) * limit / 2, ())
        if (i, free) not in memo:
            ways = [(limit / 2 + go(i + 1, free)[0], go(i + 1, free)[1])]
            for j in sorted(free):
                rest = go(i + 1, free - {j})
                ways.append((cost[i][j] + rest[0], ((i, j), *rest[1])))
            memo[i, free] = min(ways, key=lambda w: w[0])
        return memo[i, free]

    pairs = list(go(0, frozenset(range(m)))[1]) if n and m else []
    return pairs, [i for i in range(n) if i not in {a for a, _ in pairs}], [j for j in range(m) if j not in {b for _, b in pairs}]


def far(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]) + 1, min(a[3], b[3]) - max(a[1], b[1]) + 1
    if w <= 0 or h <= 0:
        return 1.0
    own = lambda z: (z[2] - z[0] + 1) * (z[3] - z[1] + 1)
    return 1 - w * h / (own(a) + own(b) - w * h)


class Association:
    """Two thresholds and optimal assignment; rows (track id, det id) of each frame."""

    def __init__(self):
        self.tracked, self.lost, self.removed, self.n, self.last, self.next = [], [], set(), 0, 0.0, 0

    def frame(self, t, dets):
        dt = t - self.last
        dt = 0.2 if dt < 0 or dt > 2 or self.n == 0 else dt
        self.last, self.n = t, self.n + 1
        seen = [{"box": [640 * d[c] for c in ("x0", "y0", "x1", "y1")], "conf": d["conf"], "det": d["det_id"]} for d in dets if d["cl"] == 0 and d["conf"] >= 0.1]
        high, low = [d for d in seen if d["conf"] >= 0.5], [d for d in seen if d["conf"] < 0.5]
        known, waiting = [k for k in self.tracked if k["active"]], [k for k in self.tracked if not k["active"]]
        pool = known + [k for k in self.lost if k["id"] not in [x["id"] for x in known]]
        for k in pool:
            if k["state"] != "tracked":
                k["filter"].x[7] = 0.0
            k["filter"].x, k["filter"].p = k["filter"].moved(dt * 5)
            k["box"] = corners(k["filter"].x)
        new = []

        def renew(k, d):
            k["filter"].meet(k["filter"].x, k["filter"].p, d["box"])
            k.update(box=corners(k["filter"].x), det=d["det"], state="tracked", active=True, frame=self.n, time=t)
            new.append(k)

        table = lambda a, b: [[far(x["box"], y["box"]) for y in b] for x in a]
        pairs, rest, left = best_pairs(table(pool, high), 0.8)
        for a, b in pairs:
            renew(pool[a], high[b])
        if not high:
            rest = list(range(len(pool)))
        if not pool:
            left = list(range(len(high)))
        rest = [pool[i] for i in rest if pool[i]["state"] == "tracked"]
        pairs, gone, _ = best_pairs(table(rest, low), 0.5)
        if not low:
            gone = list(range(len(rest)))
        for a, b in pairs:
            renew(rest[a], low[b])
        newly = [rest[i] for i in gone]
        for k in newly:
            k["state"] = "lost"
        high = [high[i] for i in left]
        pairs, gone, left = best_pairs(table(waiting, high), 0.7)
        if not high:
            gone = list(range(len(waiting)))
        if not waiting:
            left = list(range(len(high)))
        for a, b in pairs:
            renew(waiting[a], high[b])
        for i in gone:
            waiting[i]["state"] = "removed"
            self.removed.add(waiting[i]["id"])
        for i in left:
            if high[i]["conf"] >= 0.6:
                self.next += 1
                new.append({**high[i], "id": self.next, "state": "tracked", "filter": Filter(high[i]["box"]), "active": self.n == 1, "start": self.n, "frame": self.n, "time": t})
        self.removed |= {k["id"] for k in self.lost if k["state"] == "lost" and t - k["time"] > 2.0}
        joined = [k for k in self.tracked if k["state"] == "tracked"]
        for k in new:
            if k["id"] not in [x["id"] for x in joined]:
                joined.append(k)
        self.tracked = joined
        here = {k["id"] for k in joined}
        self.lost = sorted((k for k in self.lost + newly if k["id"] not in here | self.removed), key=lambda k: k["id"])
        out_a, out_b = set(), set()
        for (i, a), (j, b) in itertools.product(enumerate(self.tracked), enumerate(self.lost)):
            if far(a["box"], b["box"]) < 0.15:
                out_b.add(j) if a["frame"] - a["start"] > b["frame"] - b["start"] else out_a.add(i)
        self.tracked, self.lost = [k for i, k in enumerate(self.tracked) if i not in out_a], [k for j, k in enumerate(self.lost) if j not in out_b]
        return [(k["id"], k["det"]) for k in self.tracked]
