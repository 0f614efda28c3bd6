"""Multi-object tracking, one small state per stream."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gridlark.operators.assign import contested
from gridlark.operators.connected import connected
from gridlark.operators.ordered import largest_group, number_rows, running
from gridlark.operators.overlap import overlap_pairs
from gridlark.operators.runs import turns, whole_keys
from gridlark.session import stored_table


@dataclass
class TrackerOptions:
    dt: float = 0.033
    process_var: float = 25.0
    meas_var: float = 4.0
    aux_var: float = 16.0
    max_age: int = 15
    min_hits: int = 2
    w_iou: float = 0.55
    w_space: float = 0.30
    w_look: float = 0.30
    gate: float = 9.21
    high: float = 0.5
    low: float = 0.1
    two_stage: bool = True
    aux_radius: float = 120.0


# columns of the live-track matrix
WIDTH = 14
X, Y, VX, VY, P00, P01, P11, WID, HEI, HITS, AGE, TSU, ID, FROM = range(WIDTH)
OUT_COLUMNS = ["track_id", "x", "y", "vx", "vy", "w", "h", "class_name", "name", "hits", "age", "time_since_update", "confirmed"]
OUT_DDL = (
    "track_id bigint, x double, y double, vx double, vy double, w double, h double, class_name string, name string, "
    "hits bigint, age bigint, time_since_update bigint, confirmed boolean"
)


@dataclass
class Stream:
    """Live tracks of one stream: one row of numbers and one look each.

    A look is [class name, gallery name or None, appearance vector or None].
    """

    rows: np.ndarray = field(default_factory=lambda: np.zeros((0, WIDTH)))
    looks: list = field(default_factory=list)
    born: int = 0
    #: where the last frame's tracks could have met anything, if that is asked for
    watched: np.ndarray | None = None

    def predict(self, o: TrackerOptions) -> None:
        s, dt, q = self.rows, o.dt, o.process_var
        s[:, X] += s[:, VX] * dt
        s[:, Y] += s[:, VY] * dt
        s[:, P00] += 2 * dt * s[:, P01] + dt * dt * s[:, P11] + q * dt * dt
        s[:, P01] += dt * s[:, P11] + q * dt
        s[:, P11] += q
        s[:, AGE] += 1
        s[:, TSU] += 1

    def correct(self, which: list[int], zx: np.ndarray, zy: np.ndarray, noise: float) -> None:
        """Correct different tracks, each by a place of its own."""
        s = self.rows[which].T
        k0, k1 = s[P00] / (s[P00] + noise), s[P01] / (s[P00] + noise)
        dx, dy = zx - s[X], zy - s[Y]
        s[X] += k0 * dx
        s[Y] += k0 * dy
        s[VX] += k1 * dx
        s[VY] += k1 * dy
        s[P11] -= k1 * s[P01]
        s[P00] *= 1 - k0
        s[P01] *= 1 - k0
        self.rows[which] = s.T

    def associate(self, tracks: np.ndarray, boxes: np.ndarray, looks: list, o: TrackerOptions) -> list[tuple[int, int]]:
        if len(tracks) == 0 or len(boxes) == 0:
            return []
        s = self.rows[tracks]
        x1, y1 = s[:, X] - s[:, WID] / 2, s[:, Y] - s[:, HEI] / 2
        x2, y2 = s[:, X] + s[:, WID] / 2, s[:, Y] + s[:, HEI] / 2
        bx1, by1, bx2, by2 = boxes.T
        iw = np.minimum(x2[:, None], bx2) - np.maximum(x1[:, None], bx1)
        ih = np.minimum(y2[:, None], by2) - np.maximum(y1[:, None], by1)
        inter = np.where((iw > 0) & (ih > 0), iw * ih, 0.0)
        union = (s[:, WID] * s[:, HEI])[:, None] + (bx2 - bx1) * (by2 - by1) - inter
        iou = np.where(union > 0, inter / np.where(union > 0, union, 1.0), 0.0)
        dx, dy = s[:, X, None] - (bx1 + bx2) / 2, s[:, Y, None] - (by1 + by2) / 2
        maha = (dx * dx + dy * dy) / (s[:, P00, None] + o.meas_var)
        wide = (o.gate * np.minimum(3.0, 1.0 + 0.35 * s[:, TSU]))[:, None]
        rows, cols = np.nonzero((maha <= wide) | (iou >= 0.05))
        if not len(rows):
            return []
        far = 0.5 * np.minimum(maha[rows, cols] / np.maximum(wide[rows, 0], 1e-6), 2.0)
        cost = o.w_iou * (1 - iou[rows, cols]) + o.w_space * far
        look = [look_distance(self.looks[t], looks[j]) for t, j in zip(tracks[rows].tolist(), cols.tolist())]
        unseen = np.array([v is None for v in look], dtype=bool)
        look = np.array([0.0 if v is None else v for v in look])
        cost = np.where(unseen, cost / (o.w_iou + o.w_space), cost + o.w_look * look)
        fits = look <= 0.85
        pairs = dict(zip(zip(rows[fits].tolist(), cols[fits].tolist()), cost[fits].tolist()))
        return [(int(tracks[i]), j) for i, j in contested(pairs)]

    def reach(self, o: TrackerOptions) -> np.ndarray:
        """Boxes outside which no detection can be a candidate of the predicted tracks."""
        s = self.rows
        gate = np.sqrt(o.gate * np.minimum(3.0, 1.0 + 0.35 * s[:, TSU]) * (s[:, P00] + o.meas_var))
        w, h = np.maximum(s[:, WID] / 2, gate) + 1e-6, np.maximum(s[:, HEI] / 2, gate) + 1e-6
        return np.column_stack([s[:, X] - w, s[:, Y] - h, s[:, X] + w, s[:, Y] + h])

    def advance(self, boxes: np.ndarray, conf: np.ndarray, looks: list, points: np.ndarray, o: TrackerOptions) -> None:
        """One frame: predict, match, correct, start, take points in, retire."""
        self.predict(o)
        reach = self.reach(o) if self.watched is not None else None
        everyone = np.arange(len(self.rows))
        births = np.arange(len(boxes))
        matches = []
        if len(boxes) and o.two_stage:
            strong, weak = np.flatnonzero(conf >= o.high), np.flatnonzero((conf >= o.low) & (conf < o.high))
            first = [(t, int(strong[j])) for t, j in self.associate(everyone, boxes[strong], [looks[j] for j in strong], o)]
            rest = without(everyone, [t for t, _ in first])
            second = self.associate(rest, boxes[weak], [looks[j] for j in weak], o)
            matches = first + [(t, int(weak[j])) for t, j in second]
            free = np.ones(len(boxes), dtype=bool)
            free[[j for _, j in first]] = False
            births = strong[free[strong]]
        elif len(boxes):
            matches = self.associate(everyone, boxes, looks, o)
            births = without(births, [j for _, j in matches])
        if matches:
            hit, by = map(list, zip(*matches))
            x1, y1, x2, y2 = boxes[by].T
            self.correct(hit, (x1 + x2) / 2, (y1 + y2) / 2, o.meas_var)
            self.rows[hit, WID] = 0.8 * self.rows[hit, WID] + 0.2 * np.maximum(4.0, x2 - x1)
            self.rows[hit, HEI] = 0.8 * self.rows[hit, HEI] + 0.2 * np.maximum(4.0, y2 - y1)
            self.rows[hit, HITS] += 1
            self.rows[hit, TSU] = 0
            for t, j in matches:
                self.looks[t] = blend(self.looks[t], looks[j])
        if len(births):
            x1, y1, x2, y2 = boxes[births].T
            new = np.zeros((len(births), WIDTH))
            new[:, X], new[:, Y] = (x1 + x2) / 2, (y1 + y2) / 2
            new[:, P00], new[:, P11], new[:, HITS] = o.meas_var, 100.0, 1
            new[:, WID], new[:, HEI] = np.maximum(4.0, x2 - x1), np.maximum(4.0, y2 - y1)
            new[:, ID] = self.born + 1 + np.arange(len(births))
            new[:, FROM] = births
            self.born += len(births)
            self.rows = np.vstack([self.rows, new])
            self.looks.extend(list(looks[j]) for j in births.tolist())
        if reach is not None:
            at, far = self.rows[:, [X, Y]], o.aux_radius
            self.watched = np.vstack([reach, np.column_stack([at - far, at + far])])
        self.absorb(points, o)
        alive = self.rows[:, TSU] <= o.max_age
        if not alive.all():
            self.looks = [v for v, a in zip(self.looks, alive) if a]
            self.rows = self.rows[alive]

    def absorb(self, points: np.ndarray, o: TrackerOptions) -> None:
        """Second-sensor points: each track in turn takes the nearest one left within reach."""
        if not len(points) or not len(self.rows):
            return
        taken: dict[int, int] = {}
        # distances of as many tracks at a time as keep the table small
        step = max(1, 1_000_000 // len(points))
        for a in range(0, len(self.rows), step):
            some = self.rows[a : a + step]
            dx, dy = points[:, 0] - some[:, X, None], points[:, 1] - some[:, Y, None]
            d2 = dx * dx + dy * dy
            near = d2 < o.aux_radius**2
            rows, cols = np.nonzero(near)
            now, pick, least = -1, -1, np.inf
            for i, j, d in zip(rows.tolist(), cols.tolist(), d2[near].tolist()):
                if i != now:
                    if pick >= 0:
                        taken[pick] = a + now
                    now, pick, least = i, -1, np.inf
                if d < least and j not in taken:
                    pick, least = j, d
            if pick >= 0:
                taken[pick] = a + now
        if taken:
            z = points[list(taken)]
            self.correct(list(taken.values()), z[:, 0], z[:, 1], o.aux_var)

    def states(self, o: TrackerOptions) -> list[tuple]:
        return [
            (int(s[ID]), *s[[X, Y, VX, VY, WID, HEI]].tolist(), v[0], v[1], int(s[HITS]), int(s[AGE]), int(s[TSU]), bool(s[HITS] >= o.min_hits))
            for s, v in zip(self.rows, self.looks)
        ]


def without(some: np.ndarray, places: list[int]) -> np.ndarray:
    """`some` less those at `places`."""
    keep = np.ones(len(some), dtype=bool)
    keep[places] = False
    return some[keep]


def look_distance(a: list, b: list) -> float | None:
    """Appearance distance from vectors if both have one, else from gallery names."""
    if a[2] is not None and b[2] is not None:
        cos = float(a[2] @ b[2] / (np.linalg.norm(a[2]) * np.linalg.norm(b[2]) + 1e-8))
        return min(max(1.0 - cos, 0.0), 1.0)
    if a[1] and b[1]:
        return 0.1 if a[1] == b[1] else 0.8
    return None


def blend(old: list, new: list) -> list:
    """The newest class, the newest known gallery name, and a slowly moving vector."""
    vector = old[2]
    if new[2] is not None:
        vector = new[2] if vector is None else 0.8 * vector + 0.2 * new[2]
        norm = float(np.linalg.norm(vector))
        if old[2] is not None and norm > 1e-6:
            vector = vector / norm
    return [new[0], new[1] or old[1], vector]


def frame_arrays(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, list, np.ndarray]:
    """Arrays of a frame's rows ``(is_point, x1, y1, x2, y2, conf, class_name, name, vector)``."""
    det = [r for r in rows if r[0] == 0]
    boxes = np.array([r[1:5] for r in det], dtype=float).reshape(-1, 4)
    points = np.array([r[1:3] for r in rows if r[0] == 1], dtype=float).reshape(-1, 2)
    text = lambda v: v if isinstance(v, str) else None
    vector = lambda v: None if v is None or isinstance(v, float) else np.asarray(v, dtype=float)
    looks = [[text(r[6]), text(r[7]), vector(r[8])] for r in det]
    return boxes, np.array([r[5] for r in det], dtype=float), looks, points


def _ranges(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and place of every element of the runs ``starts .. starts + counts``."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - (np.cumsum(counts) - counts - starts)[owner]


def _near_pairs(starts: np.ndarray, counts: np.ndarray, near, most: int = 1_000_000) -> tuple:
    """Owners, places and values of the pairs that `near` keeps, some owners at a time."""
    found, a = [], 0
    upto = np.cumsum(counts)
    while a < len(counts):
        z = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + most, "right")))
        owner, place = _ranges(starts[a:z], counts[a:z])
        keep, value = near(owner + a, place)
        found.append((owner[keep] + a, place[keep], value))
        a = z
    if not found:
        return np.zeros(0, dtype=int), np.zeros(0, dtype=int), np.zeros(0)
    return tuple(np.concatenate(v) for v in zip(*found))


def _alone(rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Pairs that share neither end with another pair."""
    if not len(rows):
        return np.zeros(0, dtype=bool)
    return (np.bincount(rows)[rows] == 1) & (np.bincount(cols)[cols] == 1)


class Frames:
    """Whole frames of many groups as arrays; rows are sorted by group, frame and kind."""

    def __init__(self, batch: pa.RecordBatch, group: list[str], lead: list[str]) -> None:
        self.batch = batch
        self.starts = np.concatenate([[0], turns(batch, lead)]).astype(np.int64)
        ends = np.append(self.starts[1:], batch.num_rows)
        plain = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
        kind = plain("kind")
        self.conf, self.no = plain("conf").astype(float), plain("no")
        self.sides = np.column_stack([plain(c).astype(float) for c in ("x1", "y1", "x2", "y2")])
        self.index = plain("frame_index")[self.starts]
        until = lambda k: np.concatenate([[0], np.cumsum(kind == k)])
        per = lambda k: until(k)[ends] - until(k)[self.starts]
        self.n_det, self.n_points = per(0), per(1)
        self.det = self.starts + per(-1) + per(-2)
        self.points = self.det + self.n_det
        opens = np.concatenate([[0], turns(batch, group)])
        self.group = np.searchsorted(opens, self.starts, "right") - 1
        #: first frame and number of frames of each group
        self.first = np.searchsorted(self.starts, opens)
        self.length = np.diff(np.append(self.first, len(self.starts)))
        #: detections without a track, tracks born so far in each group, and before it
        self.free = np.ones(batch.num_rows, dtype=bool)
        self.births = np.zeros(len(self.first), dtype=np.int64)
        self.before = np.zeros(len(self.first), dtype=np.int64)
        told = np.flatnonzero(kind == -2)
        self.before[np.searchsorted(opens, told, "right") - 1] = self.no[told]
        self.vectors = None
        if "vector" in batch.schema.names and batch.column("vector").null_count < batch.num_rows:
            self.vectors = np.empty(batch.num_rows, dtype=object)
            self.vectors[:] = [None if v is None else np.asarray(v, dtype=float) for v in batch.column("vector").to_pylist()]

    def texts(self, column: str, known: dict) -> np.ndarray:
        """The column as numbers; `known` gains the new texts. A column that is not there is null."""
        if column not in self.batch.schema.names:
            return np.full(self.batch.num_rows, known[None], dtype=np.int64)
        codes = self.batch.column(column).dictionary_encode()
        numbers = np.array([known.setdefault(v, len(known)) for v in codes.dictionary.to_pylist()] + [known[None]], dtype=np.int64)
        return numbers[codes.indices.fill_null(len(numbers) - 1).to_numpy(zero_copy_only=False)]


def _frames(batches: Iterator[pa.RecordBatch], lead: list[str]) -> Iterator[tuple]:
    """Key, boxes, confidences, looks and points of each frame, and the numbers of its boxes."""
    for batch in batches:
        f = Frames(batch, lead[:-1], lead)
        at = zip(*(batch.column(c).take(pa.array(f.starts)).to_pylist() for c in lead))
        class_name, name = (batch.column(c).to_pylist() for c in ("class_name", "name"))
        for key, a, m, z in zip(at, f.det, f.points, f.points + f.n_points):
            looks = [[class_name[i], name[i], None if f.vectors is None else f.vectors[i]] for i in range(a, m)]
            yield key, f.sides[a:m], f.conf[a:m], looks, f.sides[m:z, :2], f.no[a:m].tolist()


# whole-number columns of the live tracks of many groups
OF, CLASS, NAME, BORN_AT, BORN_NO = range(5)


class Streams(Stream):
    """Live tracks of many groups, one frame of every group at a time.

    A group's frames give what `Stream` gives for them; rows are sorted by group and
    birth. Texts are numbers of `known`, where None and the empty text come first.
    """

    def __init__(self, watch: bool) -> None:
        super().__init__()
        self.watch = watch
        self.clear()

    def clear(self) -> None:
        """Nothing lives and no group goes on."""
        self.rows, self.whole, self.vectors = np.zeros((0, WIDTH)), np.zeros((0, 5), dtype=np.int64), np.zeros(0, dtype=object)
        self.known: dict = {None: 0, "": 1}
        self.births, self.before, self.key = 0, 0, None

    def keep(self, some: np.ndarray) -> None:
        self.rows, self.whole, self.vectors = self.rows[some], self.whole[some], self.vectors[some]

    def candidates(self, f: Frames, at: np.ndarray, o: TrackerOptions) -> tuple:
        """Valid pairs of tracks and detections (rows of `f`) with their cost."""
        s = self.rows.T
        w, h = s[WID], s[HEI]
        x1, y1, x2, y2 = s[X] - w / 2, s[Y] - h / 2, s[X] + w / 2, s[Y] + h / 2
        size, spread = w * h, s[P00] + o.meas_var
        wide = o.gate * np.minimum(3.0, 1.0 + 0.35 * s[TSU])

        def near(t, j):
            bx1, by1, bx2, by2 = f.sides[j].T
            iw = np.minimum(x2[t], bx2) - np.maximum(x1[t], bx1)
            ih = np.minimum(y2[t], by2) - np.maximum(y1[t], by1)
            inter = np.where((iw > 0) & (ih > 0), iw * ih, 0.0)
            union = size[t] + (bx2 - bx1) * (by2 - by1) - inter
            iou = np.where(union > 0, inter / np.where(union > 0, union, 1.0), 0.0)
            dx, dy = s[X][t] - (bx1 + bx2) / 2, s[Y][t] - (by1 + by2) / 2
            maha = (dx * dx + dy * dy) / spread[t]
            ok = (maha <= wide[t]) | (iou >= 0.05)
            t, j, iou, maha = t[ok], j[ok], iou[ok], maha[ok]
            cost = o.w_iou * (1 - iou) + o.w_space * (0.5 * np.minimum(maha / np.maximum(wide[t], 1e-6), 2.0))
            a, b = self.whole[t, NAME], self.names[j]
            look = np.where((a > 1) & (b > 1), np.where(a == b, 0.1, 0.8), np.nan)
            if f.vectors is not None:
                for i, (v, u) in enumerate(zip(self.vectors[t], f.vectors[j])):
                    if v is not None and u is not None:
                        look[i] = look_distance([None, None, v], [None, None, u])
            unseen = np.isnan(look)
            look = np.where(unseen, 0.0, look)
            fits = look <= 0.85
            ok[ok] = fits
            return ok, np.where(unseen, cost / (o.w_iou + o.w_space), cost + o.w_look * look)[fits]

        return _near_pairs(f.det[at], f.n_det[at], near)

    @staticmethod
    def matched(rows: np.ndarray, cols: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        alone = _alone(rows, cols)
        rest = ~alone
        more = contested(dict(zip(zip(rows[rest].tolist(), cols[rest].tolist()), cost[rest].tolist())))
        more = np.array(more, dtype=int).reshape(-1, 2)
        return np.concatenate([rows[alone], more[:, 0]]), np.concatenate([cols[alone], more[:, 1]])

    def together(self, f: Frames, now: np.ndarray, o: TrackerOptions) -> None:
        """One frame, `now`, of every group that still has one."""
        place = np.zeros(len(f.first), dtype=np.int64)
        place[f.group[now]] = now
        at = place[self.whole[:, OF]]
        self.predict(o)
        reach = self.reach(o) if self.watch else None
        _, boxes = _ranges(f.det[now], f.n_det[now])
        rows, cols, cost = self.candidates(f, at, o)
        free = f.free
        if o.two_stage:
            strong = f.conf[cols] >= o.high
            hit, by = self.matched(rows[strong], cols[strong], cost[strong])
            free[by] = False
            idle = np.ones(len(self.rows), dtype=bool)
            idle[hit] = False
            weak = (f.conf[cols] >= o.low) & (f.conf[cols] < o.high) & idle[rows]
            hit2, by2 = self.matched(rows[weak], cols[weak], cost[weak])
            hit, by = np.concatenate([hit, hit2]), np.concatenate([by, by2])
            births = boxes[(f.conf[boxes] >= o.high) & free[boxes]]
        else:
            hit, by = self.matched(rows, cols, cost)
            free[by] = False
            births = boxes[free[boxes]]
        if len(hit):
            x1, y1, x2, y2 = f.sides[by].T
            self.correct(hit, (x1 + x2) / 2, (y1 + y2) / 2, o.meas_var)
            self.rows[hit, WID] = 0.8 * self.rows[hit, WID] + 0.2 * np.maximum(4.0, x2 - x1)
            self.rows[hit, HEI] = 0.8 * self.rows[hit, HEI] + 0.2 * np.maximum(4.0, y2 - y1)
            self.rows[hit, HITS] += 1
            self.rows[hit, TSU] = 0
            self.whole[hit, CLASS] = self.classes[by]
            self.whole[hit, NAME] = np.where(self.names[by] > 1, self.names[by], self.whole[hit, NAME])
            if f.vectors is not None:
                for t, j in zip(hit.tolist(), by.tolist()):
                    self.vectors[t] = blend([None, None, self.vectors[t]], [None, None, f.vectors[j]])[2]
        if len(births):
            x1, y1, x2, y2 = f.sides[births].T
            new, whole = np.zeros((len(births), WIDTH)), np.zeros((len(births), 5), dtype=np.int64)
            new[:, X], new[:, Y] = (x1 + x2) / 2, (y1 + y2) / 2
            new[:, P00], new[:, P11], new[:, HITS] = o.meas_var, 100.0, 1
            new[:, WID], new[:, HEI] = np.maximum(4.0, x2 - x1), np.maximum(4.0, y2 - y1)
            frame = np.searchsorted(f.starts, births, "right") - 1
            g = f.group[frame]
            new[:, ID] = f.births[g] + 1 + np.arange(len(g)) - np.searchsorted(g, g)
            f.births += np.bincount(g, minlength=len(f.births))
            whole[:, OF], whole[:, CLASS], whole[:, NAME] = g, self.classes[births], self.names[births]
            whole[:, BORN_AT], whole[:, BORN_NO] = f.index[frame], f.no[births]
            fresh = np.full(len(births), None, dtype=object) if f.vectors is None else f.vectors[births]
            order = np.argsort(np.concatenate([self.whole[:, OF], g]), kind="stable")
            self.rows, self.whole, self.vectors = np.vstack([self.rows, new]), np.vstack([self.whole, whole]), np.concatenate([self.vectors, fresh])
            self.keep(order)
        if reach is not None:
            xy, far = self.rows[:, [X, Y]], o.aux_radius
            self.watched = (np.concatenate([at, place[self.whole[:, OF]]]), np.vstack([reach, np.column_stack([xy - far, xy + far])]))
        self.attract(f, place[self.whole[:, OF]], o)
        self.keep(self.rows[:, TSU] <= o.max_age)

    def attract(self, f: Frames, at: np.ndarray, o: TrackerOptions) -> None:
        """Points of each frame: each track in turn takes the nearest one left within reach."""

        def near(t, j):
            dx, dy = f.sides[j, 0] - self.rows[t, X], f.sides[j, 1] - self.rows[t, Y]
            d2 = dx * dx + dy * dy
            ok = d2 < o.aux_radius**2
            return ok, d2[ok]

        rows, cols, d2 = _near_pairs(f.points[at], f.n_points[at], near)
        alone = _alone(rows, cols)
        taken = dict(zip(cols[alone].tolist(), rows[alone].tolist()))
        now, pick, least = -1, -1, np.inf
        for i, j, d in zip(*(v[~alone].tolist() for v in (rows, cols, d2))):
            if i != now:
                if pick >= 0:
                    taken[pick] = now
                now, pick, least = i, -1, np.inf
            if d < least and j not in taken:
                pick, least = j, d
        if pick >= 0:
            taken[pick] = now
        if taken:
            z = f.sides[list(taken)]
            self.correct(list(taken.values()), z[:, 0], z[:, 1], o.aux_var)

    def walk(self, f: Frames, group: list[str], o: TrackerOptions) -> Iterator[tuple]:
        """All frames of `f`: the frame, numbers and whole numbers of every live track, and what was watched.

        The last group may go on in the next frames.
        """
        key = lambda i: tuple(f.batch.column(c)[i].as_py() for c in group)
        if self.key != key(0):
            self.clear()
        # texts are numbered anew, so that they do not pile up
        old = list(self.known)
        self.known = {None: 0, "": 1}
        again = {k: self.known.setdefault(old[k], len(self.known)) for k in np.unique(self.whole[:, [CLASS, NAME]]).tolist()}
        for c in (CLASS, NAME):
            self.whole[:, c] = [again[k] for k in self.whole[:, c].tolist()]
        self.classes, self.names = f.texts("class_name", self.known), f.texts("name", self.known)
        f.births[0] = f.carried = self.births
        if self.key is not None:
            f.before[0] = self.before
        step = np.arange(len(f.starts)) - f.first[f.group]
        order = np.argsort(step, kind="stable")
        last, held = len(f.first) - 1, None
        for now in np.split(order, np.cumsum(np.bincount(step))[:-1]):
            s = int(step[now[0]])
            if s and (f.length[self.whole[:, OF]] <= s).any():
                self.keep(f.length[self.whole[:, OF]] > s)
            if len(self.rows) or f.n_det[now].any():
                self.together(f, now, o)
                yield f.first[self.whole[:, OF]] + s, self.rows, self.whole, self.watched if self.watch else None
            if s == f.length[last] - 1:
                mine = self.whole[:, OF] == last
                held = self.rows[mine], self.whole[mine], self.vectors[mine]
        self.rows, self.whole, self.vectors = held
        self.whole[:, OF] = 0
        self.births, self.before, self.key = int(f.births[last]), int(f.before[last]), key(f.batch.num_rows - 1)


def _gathered(batches: Iterator[pa.RecordBatch], rows: int = 65_536) -> Iterator[pa.RecordBatch]:
    """Batches of at least `rows` rows but for the last."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def _state_columns(m: np.ndarray, n: np.ndarray, texts: list, o: TrackerOptions) -> dict:
    whole = lambda k: m[:, k].astype(np.int64)
    text = pa.array(texts, pa.string())
    return {
        "track_id": whole(ID), "x": m[:, X], "y": m[:, Y], "vx": m[:, VX], "vy": m[:, VY], "w": m[:, WID], "h": m[:, HEI],
        "class_name": text.take(pa.array(n[:, CLASS])), "name": text.take(pa.array(n[:, NAME])),
        "hits": whole(HITS), "age": whole(AGE), "time_since_update": whole(TSU), "confirmed": m[:, HITS] >= o.min_hits,
        "_born_at": n[:, BORN_AT], "_born_no": n[:, BORN_NO],
    }


def _page(f: Frames, at: np.ndarray, made: dict, lead: list[str], schema: pa.Schema) -> pa.RecordBatch:
    """A batch of `made` columns with their frames' keys; others are null."""
    made.update({c: f.batch.column(c).take(pa.array(f.starts[at])) for c in lead})
    whole = lambda field: made[field.name].cast(field.type) if isinstance(made[field.name], pa.Array) else pa.array(made[field.name], field.type)
    return pa.RecordBatch.from_arrays([whole(x) if x.name in made else pa.nulls(len(at), x.type) for x in schema], schema=schema)


_NUMBERED = "_born_at bigint, _born_no bigint"
_REACH = "_x1 double, _y1 double, _x2 double, _y2 double"


def _sorted_groups(rows: DataFrame, group: list[str]) -> DataFrame:
    """Slim rows of every group in one place, in the order of the walk."""
    slim = rows.select(*group, "frame_index", *_given(rows))
    return slim.repartition(*group).sortWithinPartitions(*group, "frame_index", "kind", "no")


def _births(rows: DataFrame, piece: list[str], o: TrackerOptions) -> DataFrame:
    """Tracks that are born in every piece, `_n`; the states themselves are not kept."""
    types = dict(rows.dtypes)
    ddl = ", ".join(f"`{c}` {types[c]}" for c in piece) + ", _n bigint"
    schema = to_arrow_schema(T.StructType.fromDDL(ddl))
    lead = [*piece, "frame_index"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        streams = Streams(watch=False)
        for batch in _gathered(whole_keys(batches, lead)):
            f = Frames(batch, piece, lead)
            for _ in streams.walk(f, piece, o):
                pass
            counts = f.births.copy()
            counts[0] -= f.carried
            firsts = batch.select(piece).take(pa.array(f.starts[f.first]))
            yield pa.RecordBatch.from_arrays([*firsts.columns, pa.array(counts, pa.int64())], schema=schema)

    counted = _sorted_groups(rows, piece).mapInArrow(run, ddl)
    return stored_table(counted.groupBy(*piece).agg(F.sum("_n").alias("_n")))


def _told(rows: DataFrame, before: DataFrame, piece: list[str]) -> DataFrame:
    """`rows` and, ahead of each piece, a row with the number of tracks `_before` it."""
    types = dict(rows.dtypes)
    columns = [*piece, "frame_index", *_given(rows)]
    own = {"frame_index": F.col("_piece"), "kind": F.lit(-2), "no": F.col("_before")}
    told = before.select(*[F.col(c) if c in piece else own.get(c, F.lit(None)).cast(types[c]).alias(c) for c in columns])
    return rows.select(*columns).unionByName(told)


def _walk(rows: DataFrame, group: list[str], o: TrackerOptions, watch: bool) -> DataFrame:
    """Track states of every group's frames; ids count from the number told, else from 1, in each group.

    With `watch`, rows without a track tell where the tracks of the frame could have met
    a detection or a point.
    """
    lead = [*group, "frame_index"]
    types = dict(rows.dtypes)
    ddl = ", ".join(f"`{c}` {types[c]}" for c in lead) + f", {OUT_DDL}" + (f", {_NUMBERED}, {_REACH}" if watch else "")
    schema = to_arrow_schema(T.StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        streams = Streams(watch)

        def pages(f, states, watched):
            if states:
                at, m, n = (np.concatenate(v) for v in zip(*states))
                # track by track, as a track's neighbouring states are alike and pack well
                order = np.lexsort((at, m[:, ID], n[:, OF]))
                yield _page(f, at[order], _state_columns(m[order], n[order], list(streams.known), o), lead, schema)
            if watched:
                at, m = (np.concatenate(v) for v in zip(*watched))
                yield _page(f, at, {c: m[:, k] for k, c in enumerate(("_x1", "_y1", "_x2", "_y2"))}, lead, schema)

        for batch in _gathered(whole_keys(batches, lead)):
            f, states, watched, n = Frames(batch, group, lead), [], [], 0
            for at, m, whole, seen in streams.walk(f, group, o):
                m, whole = m.copy(), whole.copy()
                m[:, ID] += f.before[whole[:, OF]]
                states.append((at, m, whole))
                watched += [seen] if seen is not None else []
                n += len(at)
                if n >= 100_000:
                    yield from pages(f, states, watched)
                    states, watched, n = [], [], 0
            yield from pages(f, states, watched)

    return _sorted_groups(rows, group).mapInArrow(run, ddl)


_COLUMNS = ["kind", "no", "x1", "y1", "x2", "y2", "conf", "class_name", "name", "vector"]


def _given(rows: DataFrame) -> list[str]:
    """The columns of detections and points that `rows` has; looks nobody gave are not carried along."""
    return [c for c in _COLUMNS if c in rows.columns]


def _parts(rows: DataFrame, piece: list[str], o: TrackerOptions, cell: float) -> DataFrame:
    """`rows` of busy pieces with `_part`: groups of detections and points that lie near each other.

    Cells of space and time that hold something are nodes, neighbours are linked. A part
    gets a marker row for every frame from its first detection until its tracks must have
    retired. A part may hold nothing but points, which no track is guessed to meet.
    """
    blocks = [F.floor(F.col("_frame") / (o.max_age + 2))]
    middle = lambda lo, hi: F.when(F.col("kind") == 0, (F.col(lo) + F.col(hi)) / 2).otherwise(F.col(lo))
    blocks += [F.floor(middle("x1", "x2") / cell), F.floor(middle("y1", "y2") / cell)]
    names = ["_ct", "_cx", "_cy"]
    # a collision of node ids only joins two parts
    node = lambda *shift: F.xxhash64(*piece, *[F.col(c) + d for c, d in zip(names, shift)])
    placed = rows.where("kind >= 0").withColumns(dict(zip(names, blocks))).withColumn("_node", node(0, 0, 0))
    cells = stored_table(placed.select(*piece, *names, "_node").distinct())
    ahead = [d for d in product((-1, 0, 1), repeat=3) if d > (0, 0, 0)]
    links = cells.select(F.col("_node").alias("a"), F.explode(F.array(*[node(*d) for d in ahead])).alias("b"))
    links = links.join(cells.select(F.col("_node").alias("b")).distinct(), "b")
    roots = stored_table(connected(links))
    named = cells.select("_node").distinct().join(roots.withColumnRenamed("node", "_node"), "_node", "left")
    named = stored_table(named.select("_node", F.coalesce("root", "_node").alias("_part")))
    return placed.join(named, "_node").drop(*names, "_node")


def _with_markers(parts: DataFrame, rows: DataFrame, piece: list[str], o: TrackerOptions) -> DataFrame:
    """The parts' rows and a marker for each frame in which they may have tracks."""
    life = parts.where("kind = 0").groupBy(*piece, "_part").agg(F.min("_frame").alias("a"), (F.max("_frame") + o.max_age + 1).alias("z"))
    ticks = life.withColumn("_frame", F.explode(F.sequence("a", "z"))).drop("a", "z")
    there = rows.select(*piece, "_frame", "frame_index").distinct()
    marks = ticks.join(there, [*piece, "_frame"])
    blank = [F.lit(-1).alias("kind"), F.lit(0).cast("bigint").alias("no")]
    types = dict(parts.dtypes)
    rest = [F.lit(None).cast(types[c]).alias(c) for c in _given(parts)[2:]]
    columns = [*piece, "_part", "_frame", "frame_index"]
    return parts.select(*columns, *_given(parts)).unionByName(marks.select(*columns, *blank, *rest))


def _apart(rows: DataFrame, piece: list[str], o: TrackerOptions, cell: float) -> DataFrame:
    """States of busy pieces, tracked part by part and checked.

    The parts are a guess. The guess is right if no track ever came so near to a
    detection or a point of another part that it could have looked at it, which the
    walks report frame by frame. Parts that met are joined and walked again until none
    meet, so the result is that of one walk over everything, however far tracks move.
    """
    parts = stored_table(_parts(rows, piece, o, cell))
    group, todo, done = [*piece, "_part"], parts, None
    while True:
        walked = stored_table(_walk(_with_markers(todo, rows, piece, o), group, o, watch=True))
        frame = [*piece, "frame_index"]
        seen = walked.where("track_id is null").select(*frame, "_part", *[F.col("_" + c).alias(c) for c in ("x1", "y1", "x2", "y2")])
        hair = F.lit(1e-6)
        dot = F.col("kind") == 1
        there = parts.select(
            *frame, "_part", (F.col("x1") - hair).alias("x1"), (F.col("y1") - hair).alias("y1"),
            (F.when(dot, F.col("x1")).otherwise(F.col("x2")) + hair).alias("x2"), (F.when(dot, F.col("y1")).otherwise(F.col("y2")) + hair).alias("y2"),
        )
        met = overlap_pairs(seen, there, frame, "r_", F.col("_part") != F.col("r__part"))
        met = stored_table(met.select(F.col("_part").alias("a"), F.col("r__part").alias("b")).distinct())
        states = walked.where("track_id is not null").drop("_x1", "_y1", "_x2", "_y2")
        done = states if done is None else done.union(states)
        if met.isEmpty():
            return done
        joined = stored_table(connected(met).toDF("_part", "_root"))
        done = stored_table(done.join(joined.select("_part"), "_part", "left_anti").select(*done.columns))
        after = parts.join(joined, "_part", "left").withColumn("_part", F.coalesce("_root", "_part"))
        parts = stored_table(after.drop("_root"))
        todo = parts.join(joined.select(F.col("_root").alias("_part")).distinct(), "_part", "left_semi")


def track_multi(
    frames: DataFrame,
    detections: DataFrame,
    keys: Sequence[str],
    points: DataFrame | None = None,
    options: TrackerOptions | None = None,
    busy_rows: int = 200_000,
    cell: float | None = None,
    **ordered,
) -> DataFrame:
    """Track states after every frame of every stream.

    `frames` lists each stream's frames (``keys, frame_index``), `detections` adds
    ``det_no, x1, y1, x2, y2, conf`` and optionally `class_name`, `name` (gallery class) and `vector`, and `points` adds ``point_no, x, y``. A stream
    is cut wherever it has been quiet long enough for every track to have retired, and
    the pieces are tracked apart. A piece of more than `busy_rows` rows is cut in space as
    well, by neighbouring cells of side `cell` (twice the reach of points unless given),
    and the cut is checked, so both give the states of one walk. Tracks are numbered per
    stream by birth: frame, then `det_no`. Rows reach the helper in Arrow batches of
    whole frames, so a stream is never held whole.
    """
    o = options or TrackerOptions()
    keys = list(keys)
    none = lambda ty: F.lit(None).cast(ty)
    looks = {"class_name": "string", "name": "string", "vector": "array<double>"}
    looks = {c: ty for c, ty in looks.items() if c in detections.columns}
    columns = [*_COLUMNS[:7], *looks]
    blank = [none(ty).alias(c) for c, ty in looks.items()]
    things = detections.select(
        *keys, "frame_index", F.lit(0).alias("kind"), F.col("det_no").cast("bigint").alias("no"),
        *[F.col(c).cast("double").alias(c) for c in columns[2:7]],
        *[F.col(c).cast(ty).alias(c) for c, ty in looks.items()],
    )
    if points is not None:
        things = things.unionByName(
            points.select(
                *keys, "frame_index", F.lit(1).alias("kind"), F.col("point_no").cast("bigint").alias("no"), F.col("x").cast("double").alias("x1"),
                F.col("y").cast("double").alias("y1"), *[none("double").alias(c) for c in columns[4:7]], *blank,
            )
        )
    # streams are cut by what their frames hold, one narrow row for each
    every = frames.select(*keys, "frame_index", F.lit(-1).alias("kind")).union(things.select(*keys, "frame_index", "kind"))
    place = [*keys, "frame_index"]
    every = stored_table(every.groupBy(*place).agg(F.max(F.col("kind") == 0).alias("_det"), F.count("*").alias("_rows")))
    size = largest_group(every, keys)
    ordered = {**ordered, "size": size}
    # tracks age by frames that are there, not by what their indices say
    counted = number_rows(every, keys, ["frame_index"], "_frame", **ordered)
    seen = running(counted, keys, ["frame_index"], {"_last": ("last", F.when(F.col("_det"), F.col("_frame")), False)}, **ordered)
    # tracks retire at the end of the frame max_age + 1 frames after their last one
    fresh = F.col("_det") & (F.col("_last").isNull() | (F.col("_frame") - F.col("_last") >= o.max_age + 2))
    cut = running(seen, keys, ["frame_index"], {"_piece": ("last", F.when(fresh, F.col("frame_index")), True)}, **ordered)
    cut = stored_table(cut.where("_piece IS NOT NULL").select(*place, "_frame", "_piece", "_rows"))
    piece = [*keys, "_piece"]
    marks = cut.select(
        *piece, "_frame", "frame_index", F.lit(-1).alias("kind"), F.lit(0).cast("bigint").alias("no"), *[none("double").alias(c) for c in columns[2:7]], *blank
    )
    base = things.join(cut.drop("_rows"), place).select(*piece, "_frame", "frame_index", *columns).unionByName(marks)
    # read by both walks
    base = stored_table(base)
    # fewer than rows / busy_rows pieces can pass this filter, so the table is small
    busy = stored_table(cut.groupBy(*piece).agg(F.sum("_rows").alias("_n")).where(F.col("_n") > busy_rows).select(*piece))
    crowded = None if busy.isEmpty() else base.join(F.broadcast(busy), piece, "left_semi")
    whole = base if crowded is None else base.join(F.broadcast(busy), piece, "left_anti")
    # pieces follow each other and so do their tracks' numbers
    born = _births(whole, piece, o)
    group = [*piece, "_part"]
    if crowded is not None:
        walked = _apart(crowded, piece, o, cell or 2 * o.aux_radius)
        # a track has one state in the frame of its birth
        tracks = stored_table(walked.where("frame_index = _born_at").select(*group, "track_id", "_born_at", "_born_no"))
        born = born.unionByName(tracks.groupBy(*piece).agg(F.count("*").alias("_n")))
    before = running(born, keys, ["_piece"], {"_before": ("sum", F.col("_n"), False)}, **{**ordered, "size": size})
    before = before.select(*piece, F.coalesce("_before", F.lit(0)).cast("bigint").alias("_before"))
    if crowded is not None:
        before = stored_table(before)
    told = before if crowded is None else before.join(F.broadcast(busy), piece, "left_anti")
    columns = [*keys, "frame_index", *OUT_COLUMNS]
    states = _walk(_told(whole, told, piece), piece, o, watch=False).select(*columns)
    if crowded is None:
        return states
    ids = number_rows(tracks, piece, ["_born_at", "_born_no", "_part", "track_id"], "_id", **{k: v for k, v in ordered.items() if k != "size"})
    ids = ids.join(before, piece).select(*group, "track_id", (F.col("_id") + F.col("_before")).alias("_id"))
    named = walked.join(ids, [*group, "track_id"]).withColumn("track_id", F.col("_id"))
    return states.unionByName(named.select(*columns))
