"""How many paths meet each of many rectangles, without a row for each pair.

Rectangles lie in the grid cell of their lower left corner, so each lies in one
cell only; an edge visits every cell whose rectangles it can reach. In a cell
the edges and rectangles are tested as a matrix, the edges of a path together,
so that a path counts once for a rectangle whatever its edges: nothing has to
be remembered beyond the cell but one number for each rectangle.

A segment and a rectangle meet if their envelopes do and the rectangle's corners
are not all strictly on one side of the segment's line (``seg_hits_rect_sql``).
Where an edge passes through all of what a cell's rectangles cover, the line
alone decides; its signed distances come from a product of 32-bit matrices, and
what lies within its rounding error is tested again as the SQL does it, as are
edges that end there and paths with several edges there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

MAX_CELLS = 1 << 16        # of a grid, so that cell numbers have 16 bits
CHUNK = 1 << 18            # edges at a time, about
BAND_VISITS = 1 << 19      # (edge, cell) at a time, about
CLASS = 4.0                # rectangles of a grid differ in size by this factor at most
VISIT, TEST = 200.0, 2.0   # what a visit of an edge to a cell costs, and a test of one rectangle there
TALL, WIDE = 255, 512      # edges and rectangles tested at a time; so many edges are counted in 8 bits


def _meets(e: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Edges (ax, ay, bx, by) and rectangles (x0, y0, x1, y1), which broadcast
    against each other. Rounding is monotonic, so the extreme products are those
    of the extreme corners."""
    ax, ay, bx, by = e
    x0, y0, x1, y1 = r
    dx, dy = bx - ax, by - ay
    u0, u1, v0, v1 = dx * (y0 - ay), dx * (y1 - ay), dy * (x0 - ax), dy * (x1 - ax)
    out = (np.maximum(u0, u1) >= np.minimum(v0, v1)) & (np.minimum(u0, u1) <= np.maximum(v0, v1))
    out &= (np.maximum(ax, bx) >= x0) & (np.minimum(ax, bx) <= x1)
    out &= (np.maximum(ay, by) >= y0) & (np.minimum(ay, by) <= y1)
    return out


def _steps(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts n: the number of each one's entries and 0, 1, ... in each."""
    of = np.repeat(np.arange(len(n), dtype=np.int32), n)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)


class _Grid:
    """The rectangles (4 x n) of one class of size, by cell."""

    def __init__(self, at: np.ndarray, box: np.ndarray):
        wide = max(float((box[2] - box[0]).max()), float((box[3] - box[1]).max()))
        left, low = float(box[0].min()), float(box[1].min())
        far = float(np.abs(box).max())
        across, up = float(box[0].max()) - left, float(box[1].max()) - low
        dense = len(at) / max((across + wide) * (up + wide), 1e-300)
        cells = lambda g: (across // g + 2) * (up // g + 2)
        sizes = [g for g in (wide * 2.0 ** x for x in range(-3, 80)) if cells(g) <= MAX_CELLS]
        g = self.g = min(sizes, key=lambda g: (g + wide) * (VISIT / g ** 2 + dense * TEST))
        self.left, self.low, self.reach = left, low, g + wide
        # far more than the rounding of coordinates, far less than a cell
        self.pad = self.reach * 1e-6 + far * 1e-13
        cx, cy = np.floor((box[0] - left) / g).astype(np.int64), np.floor((box[1] - low) / g).astype(np.int64)
        self.nx, self.ny = int(cx.max()) + 1, int(cy.max()) + 1
        key = cy * self.nx + cx
        order = np.argsort(key, kind="stable")
        self.at, self.box, key = at[order], np.ascontiguousarray(box[:, order]), key[order]
        begins = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        self.ends = np.append(begins, len(key))
        self.number = np.full(self.nx * self.ny, -1, np.int32)
        self.number[key[begins]] = np.arange(len(begins))
        self.mid_x = left + (key[begins] % self.nx) * g + self.reach / 2
        self.mid_y = low + (key[begins] // self.nx) * g + self.reach / 2
        self.within = 2.0 ** -19 * (self.reach / 2 + self.pad) + far * 2.0 ** -46
        x0, y0, x1, y1 = self.box
        cell = np.repeat(np.arange(len(begins)), np.diff(self.ends))
        one, x, y = np.ones(len(key)), (x0 + x1) / 2 - self.mid_x[cell], (y0 + y1) / 2 - self.mid_y[cell]
        self.mids = np.array([y, x, one], np.float32)
        self.halves = np.array([(y1 - y0) / 2, (x1 - x0) / 2], np.float32)
        self.space = [np.empty(TALL * WIDE, x) for x in (np.float32, np.float32, bool, bool)]

    def flat(self, e: np.ndarray) -> np.ndarray:
        """Edges so flat that their places in a row of cells are inexact."""
        dx, dy = np.abs(e[2] - e[0]), np.abs(e[3] - e[1])
        return dx * 1e-3 >= dy

    def visits(self, e: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Edges and the cells they visit, sorted by cell and edge, some cells at
        a time. A cell is visited if the edge comes to within ``pad`` (a flat
        edge: its envelope) of what the cell's rectangles can cover. Besides, how
        far the cell's middle lies from the edge's line, and whether the edge may
        end there."""
        g, pad, tall = self.g, self.pad, self.reach - self.g
        ax, ay, bx, by = e
        lo_x, hi_x, lo_y, hi_y = np.minimum(ax, bx), np.maximum(ax, bx), np.minimum(ay, by), np.maximum(ay, by)
        cell = lambda v, most: np.clip(np.floor(v / g), -1, most + 1).astype(np.int64)
        r0, r1 = np.maximum(cell(lo_y - self.low - tall - pad, self.ny), 0), np.minimum(cell(hi_y - self.low + pad, self.ny), self.ny - 1)
        meet = (hi_x >= self.left - pad) & (lo_x <= self.left + self.nx * g + tall + pad) & (r0 <= r1)
        edges = np.flatnonzero(meet)
        flat = self.flat(e)
        slope = np.where(flat, 0.0, (bx - ax) / np.where(flat, 1.0, by - ay))
        r0, r1 = r0[edges], r1[edges]
        dx, dy = bx - ax, by - ay
        length = np.hypot(dx, dy)
        loose = flat | (length == 0)
        nx, ny = (v / np.where(length == 0, 1.0, length) for v in (dx, dy))
        # the cells of which the rectangles can reach an edge's ends
        near = [(cell(x - self.left - tall - 3 * pad, self.nx), cell(x - self.left + 3 * pad, self.nx),
                 cell(y - self.low - tall - 3 * pad, self.ny), cell(y - self.low + 3 * pad, self.ny)) for x, y in ((ax, ay), (bx, by))]
        wide = 1 + ((hi_x - lo_x)[edges] + self.reach) / g / (r1 - r0 + 1)
        load = np.cumsum((np.bincount(r0, wide, self.ny + 1) - np.bincount(r1 + 1, wide, self.ny + 1))[:self.ny])
        row = 0
        while row < self.ny:
            until = row + max(1, int(np.searchsorted(np.cumsum(load[row:]), BAND_VISITS, "right")))
            some = np.flatnonzero((r0 < until) & (r1 >= row))
            first = np.maximum(r0[some], row)
            of, step = _steps(np.minimum(r1[some], until - 1) - first + 1)
            i, cy = edges[some[of]], first[of] + step
            y = self.low + cy * g
            ya, yb = (np.clip(v, lo_y[i], hi_y[i]) for v in (y - pad, y + self.reach + pad))
            xa, xb = (ax[i] + (v - ay[i]) * slope[i] for v in (ya, yb))
            xl = np.where(flat[i], lo_x[i], np.maximum(np.minimum(xa, xb), lo_x[i])) - pad
            xr = np.where(flat[i], hi_x[i], np.minimum(np.maximum(xa, xb), hi_x[i])) + pad
            c0, c1 = np.maximum(cell(xl - self.left - tall, self.nx), 0), np.minimum(cell(xr - self.left, self.nx), self.nx - 1)
            bounds = []
            for x0, x1, y0, y1 in near:
                here = (cy >= y0[i]) & (cy <= y1[i])
                bounds.append((np.where(loose[i], -1, np.where(here, x0[i], self.nx)), np.where(loose[i], self.nx, x1[i])))
            away = ny[i] * (ax[i] - self.left - self.reach / 2) - nx[i] * (ay[i] - y - self.reach / 2)
            turn = ny[i] * g
            windows = int(max(1, np.maximum(c1 - c0 + 1, 0).sum() // BAND_VISITS))
            for w in range(windows):
                w0, w1 = w * self.nx // windows, (w + 1) * self.nx // windows - 1
                b0 = np.maximum(c0, w0)
                of, step = _steps(np.maximum(np.minimum(c1, w1) - b0 + 1, 0))
                cx = b0[of] + step
                number = self.number[cy[of] * self.nx + cx]
                there = np.flatnonzero(number >= 0)
                number, of, cx = number[there].astype(np.uint16), of[there], cx[there]
                ends = np.zeros(len(of), bool)
                for x0, x1 in bounds:
                    ends |= (cx >= x0[of]) & (cx <= x1[of])
                far = (away[of] - turn[of] * cx).astype(np.float32)
                order = np.argsort(number, kind="stable")
                yield i[of][order], number[order], far[order], ends[order]
            row = until

    def add(self, counts: np.ndarray, path: np.ndarray, e: np.ndarray) -> None:
        """Adds to ``counts`` the paths that meet each rectangle; edges of a path
        lie together."""
        dx, dy = e[2] - e[0], e[3] - e[1]
        length = np.hypot(dx, dy)
        length = np.where(length == 0, 1.0, length)
        nx, ny = (dx / length).astype(np.float32), (dy / length).astype(np.float32)
        line = np.array([nx, -ny, nx, np.abs(nx), np.abs(ny)]).T
        out = np.zeros(len(self.at), np.int64)
        for i, number, far, ends in self.visits(e):
            owner = path[i]
            same = (number[1:] == number[:-1]) & (owner[1:] == owner[:-1])
            ends[1:] |= same
            ends[:-1] |= same
            rows = line[i]
            rows[:, 2] = far
            for some in (np.flatnonzero(~ends), np.flatnonzero(ends)):
                cells = number[some]
                begins = np.flatnonzero(np.concatenate((cells[:1] == cells[:1], cells[1:] != cells[:-1])))
                for x, y in zip(begins, [*begins[1:], len(some)]):
                    at = some[x:y]
                    if ends[at[0]]:
                        self._ends(out, owner[at], e, i[at], rows[at], cells[x])
                    else:
                        self._through(out, e, i[at], rows[at], cells[x])
        counts[self.at] += out

    def _sides(self, rows: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Whether the lines of some edges surely and maybe meet the rectangles
        from lo to hi of a cell; good until the next call."""
        size, shape = len(rows) * (hi - lo), (len(rows), hi - lo)
        m, r, sure, maybe = (x[:size].reshape(shape) for x in self.space)
        np.matmul(rows[:, :3], self.mids[:, lo:hi], out=m)
        np.matmul(rows[:, 3:], self.halves[:, lo:hi], out=r)
        np.abs(m, out=m)
        np.subtract(m, r, out=m)
        return np.less(m, -self.within, out=sure), np.less_equal(m, self.within, out=maybe)

    @staticmethod
    def _between(sure: np.ndarray, maybe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and columns of what is not sure; takes ``maybe``."""
        return np.divmod(np.flatnonzero(np.not_equal(maybe, sure, out=maybe)), maybe.shape[1])

    def _through(self, out, e, i, rows, c) -> None:
        """Edges that pass through all that the cell's rectangles cover."""
        first, last = self.ends[c], self.ends[c + 1]
        for lo in range(first, last, WIDE):
            hi = min(lo + WIDE, last)
            for x in range(0, len(i), TALL):
                sure, maybe = self._sides(rows[x:x + TALL], lo, hi)
                n = np.add.reduce(sure.view(np.uint8), 0, dtype=np.uint8)
                out[lo:hi] += n
                if (n != np.add.reduce(maybe.view(np.uint8), 0, dtype=np.uint8)).any():
                    j, k = self._between(sure, maybe)
                    np.add.at(out, lo + k[_meets(e[:, i[x + j]], self.box[:, lo + k])], 1)

    def _ends(self, out, owner, e, i, rows, c) -> None:
        """Edges that end in a cell or share it with others of their path."""
        first, last = self.ends[c], self.ends[c + 1]
        new = np.concatenate(([True], owner[1:] != owner[:-1]))
        group = np.cumsum(new) - 1
        rank = np.arange(len(i)) - np.flatnonzero(new)[group]
        turns = np.argsort(rank, kind="stable")
        cuts = np.cumsum(np.bincount(rank))
        ax, ay, bx, by = e[:, i, None]
        x_lo, x_hi, y_lo, y_hi = np.minimum(ax, bx), np.maximum(ax, bx), np.minimum(ay, by), np.maximum(ay, by)
        for lo in range(first, last, WIDE):
            hi = min(lo + WIDE, last)
            x0, y0, x1, y1 = self.box[:, lo:hi]
            met = np.zeros((cuts[0], hi - lo), bool)
            # in turns: every path's first edge, every second one, and so on
            for turn, (begin, end) in enumerate(zip([0, *cuts], cuts)):
                for x in range(begin, end, TALL):
                    at = turns[x:min(x + TALL, end)]
                    sure, maybe = self._sides(rows[at], lo, hi)
                    there = x_hi[at] >= x0
                    there &= x_lo[at] <= x1
                    there &= y_hi[at] >= y0
                    there &= y_lo[at] <= y1
                    sure &= there
                    maybe &= there
                    j, k = self._between(sure, maybe)
                    sure[j, k] = _meets(e[:, i[at[j]]], self.box[:, lo + k])
                    if turn == 0:
                        met[group[at]] = sure
                    else:
                        met[group[at]] |= sure
            for x in range(0, len(met), TALL):
                out[lo:hi] += np.add.reduce(met[x:x + TALL].view(np.uint8), 0, dtype=np.uint8)


class Boxes:
    """Rectangles (4 x n: x0, y0, x1, y1), to be counted at."""

    def __init__(self, box: np.ndarray):
        self.counts, self.grids = np.zeros(box.shape[1], np.int64), []
        size = np.maximum(box[2] - box[0], box[3] - box[1])
        order = np.argsort(-size, kind="stable")
        falling, begin = -size[order], 0
        while begin < len(order):
            end = int(np.searchsorted(falling, falling[begin] / CLASS, "left"))
            end = max(end, begin + 1)
            at = order[begin:end]
            self.grids.append(_Grid(at, box[:, at]))
            begin = end

    def add(self, path: np.ndarray, edges: np.ndarray) -> None:
        """Counts the paths whose edges (4 x m) meet each rectangle; ``path``, one
        for each edge, rises."""
        for g in self.grids:
            g.add(self.counts, path, edges)


def counted(batches: Iterator[pa.RecordBatch], at: np.ndarray, box: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Of batches of paths (``edges``, a list of ax, ay, bx, by), the numbers of
    paths that meet each rectangle, for those that any meets."""
    if not len(at):
        return
    boxes, path, edges, waiting = None, [], [], 0

    def flush():
        nonlocal boxes, waiting
        if waiting:
            boxes = boxes or Boxes(np.array(box))
            # paths are told apart by their rank; a batch's begin with new ones
            boxes.add(np.concatenate(path), np.concatenate(edges, axis=1))
        path.clear(), edges.clear()
        waiting = 0

    number = 0
    for b in batches:
        lists = b.column(0)
        n = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten()
        if len(flat):
            path.append(np.repeat(np.arange(number, number + len(n)), n))
            edges.append(np.array([flat.field(c).to_numpy() for c in ("ax", "ay", "bx", "by")]))
            waiting += len(flat)
        number += len(n)
        if waiting >= CHUNK:
            flush()
    flush()
    if boxes is not None:
        met = np.flatnonzero(boxes.counts)
        for x in range(0, len(met), 1 << 16):
            some = met[x:x + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(at[some]), pa.array(boxes.counts[some])], ["p_at", "n"])
