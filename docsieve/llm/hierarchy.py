"""Minimum spanning forests, and the density hierarchy that they hold."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from docsieve.llm.vectors import cosines


class Sets:
    """Disjoint sets of 0..n-1; the smallest member leads its set."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True

    def leaders(self) -> np.ndarray:
        return np.array([self.find(x) for x in range(len(self.up))], np.int64)


def dense_forest(vectors: np.ndarray, core: np.ndarray, furthest: float, tile: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Borůvka's spanning forest of the mutual-reachability graph of unit vectors, edges up to squared distance ``furthest``.

    In each round every open component takes its lightest edge to another one; a component
    without such an edge within ``furthest`` is closed. ``core`` holds squared core distances.
    """
    n = len(vectors)
    x, c = vectors.astype(np.float32), core.astype(np.float32)
    sets, component, open_ = Sets(n), np.arange(n), np.ones(n, bool)
    out_a, out_b, out_w = [], [], []
    while True:
        rows = np.nonzero(open_[component])[0]
        nearest, weight = np.zeros(n, np.int64), np.full(n, np.inf, np.float32)
        columns = rows  # a closed component has no edge to an open one either
        other, other_core, other_component = x[columns], c[columns], component[columns]
        for begin in range(0, len(rows), tile):
            part = rows[begin : begin + tile]
            d = x[part] @ other.T
            d *= -2
            d += 2
            np.maximum(d, other_core[None], out=d)
            np.maximum(d, c[part][:, None], out=d)
            d[component[part][:, None] == other_component[None]] = np.inf
            at = d.argmin(axis=1)
            nearest[part], weight[part] = columns[at], d[np.arange(len(part)), at]
        order = rows[np.lexsort((rows, weight[rows], component[rows]))] if len(rows) else rows
        if not len(order):
            break
        first = order[np.r_[True, component[order][1:] != component[order][:-1]]]
        good = first[weight[first] <= furthest]
        open_[component[first[weight[first] > furthest]]] = False
        added = 0
        for a in good[np.lexsort((good, weight[good]))].tolist():
            b = int(nearest[a])
            if sets.join(a, b):
                out_a.append(min(a, b)), out_b.append(max(a, b)), out_w.append(float(weight[a]))
                added += 1
        if not added:
            break
        before, component = component, sets.leaders()
        still = np.zeros(n, bool)
        still[component[rows]] |= open_[before[rows]]
        open_ = still
    return np.array(out_a, np.int64), np.array(out_b, np.int64), np.array(out_w)


def sparse_forest(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Numbers of the edges, lightest first, that make a spanning forest of the graph."""
    sets, kept = Sets(n), []
    order = np.lexsort((np.maximum(a, b), np.minimum(a, b), w))
    for e, x, y in zip(order.tolist(), a[order].tolist(), b[order].tolist(), strict=True):
        if sets.join(x, y):
            kept.append(e)
    return np.array(kept, np.int64)


@dataclass
class Hierarchy:
    """``label``: number of the selected cluster of each point or -1; ``persistence``: 1 / distance at which the point joined a cluster."""

    label: np.ndarray
    persistence: np.ndarray


def density_hierarchy(n: int, a: np.ndarray, b: np.ndarray, distance: np.ndarray, least_size: int, furthest: float, whole: float = 0.0) -> Hierarchy:
    """Condenses the forest bottom-up and selects the clusters of largest excess of mass.

    A component becomes a cluster when it reaches ``least_size``; two clusters that meet become
    the children of a new one. The stability of a cluster sums, over its points, the density at
    which the point leaves it less the density at which the cluster parts from its parent.
    Components that never meet within ``furthest`` part there from a common root that is no cluster. Clusters that part within ``whole``
    are never told apart, however stable.
    """
    order = np.argsort(distance, kind="stable")
    size = [1] * n
    sets = Sets(n)
    small: dict[int, list[int]] = {x: [x] for x in range(n)}
    cluster: dict[int, int] = {}
    mass: list[float] = []
    count: list[int] = []
    parent: list[int] = []
    birth: list[float] = []
    parted: list[float] = []
    inner, persistence = np.full(n, -1, np.int64), np.zeros(n)

    def grow(c: int, points: list[int], density: float) -> None:
        for p in points:
            inner[p], persistence[p] = c, density
            mass[c] += density
            count[c] += 1

    def new(density: float) -> int:
        mass.append(0.0), count.append(0), parent.append(-1), birth.append(0.0), parted.append(density)
        return len(mass) - 1

    most = 1e6
    for x, y, d in zip(a[order].tolist(), b[order].tolist(), distance[order].tolist(), strict=True):
        x, y = sets.find(x), sets.find(y)
        if x == y:
            continue
        density = min(most, 1 / max(d, 1e-6))
        sets.join(x, y)
        lead, total = min(x, y), size[x] + size[y]
        cx, cy = cluster.pop(x, -1), cluster.pop(y, -1)
        sx, sy = small.pop(x, []), small.pop(y, [])
        size[lead] = total
        if cx >= 0 and cy >= 0:
            c = new(density)
            for child in (cx, cy):
                parent[child], birth[child] = c, density
                mass[c] += density * count[child]
                count[c] += count[child]
            cluster[lead] = c
        elif cx >= 0 or cy >= 0:
            c = max(cx, cy)
            grow(c, sx + sy, density)
            cluster[lead] = c
        elif total >= least_size:
            c = new(density)
            grow(c, sx + sy, density)
            cluster[lead] = c
        else:
            small[lead] = sx + sy
    root = 1 / max(furthest, 1e-6)
    for c in cluster.values():
        birth[c] = root
    stability = [m - k * s for m, k, s in zip(mass, count, birth, strict=True)]
    best, below = list(stability), [-1.0] * len(mass)  # below 0: without children that could be told apart
    chosen = [True] * len(mass)
    for c in range(len(mass)):  # children come before their parents
        if below[c] >= 0 and below[c] > stability[c]:
            best[c], chosen[c] = below[c], False
        if (p := parent[c]) >= 0 and parted[p] * whole < 1 - 1e-9:
            below[p] = max(below[p], 0.0) + max(best[c], 0.0)
    label = [-1] * len(mass)
    for c in range(len(mass) - 1, -1, -1):
        above = label[parent[c]] if parent[c] >= 0 else -1
        label[c] = above if above >= 0 else (c if chosen[c] else -1)
    lookup = np.array(label + [-1], np.int64)
    return Hierarchy(lookup[inner], persistence)


class Band:
    """The part of ``density_hierarchy`` that some consecutive edges of a forest make, ``edges`` lightest first.

    A point is a component of lighter edges: ``size`` rows, and if ``clustered``, an open cluster of mass ``mass`` whose
    children are worth ``below`` (less than 0 without children that could be told apart).
    """

    def __init__(self, n: int, a: np.ndarray, b: np.ndarray, distance: np.ndarray, least_size: int, whole: float, size: np.ndarray, mass: np.ndarray, below: np.ndarray, clustered: np.ndarray):
        self.sets, self.size = Sets(n), size.tolist()
        self.mass: list[float] = []
        self.count: list[int] = []
        self.parent: list[int] = []
        self.birth: list[float] = []
        self.below: list[float] = []
        self.start, self.inner, self.persistence = size.tolist(), np.full(n, -1, np.int64), np.zeros(n)
        self.cluster: dict[int, int] = {}
        small: dict[int, list[int]] = {}
        most = 1e6
        for p, has in enumerate(clustered.tolist()):
            if has:
                c = self._new()
                self.mass[c], self.count[c], self.below[c] = float(mass[p]), self.size[p], float(below[p])
                self.inner[p] = self.cluster[p] = c
            else:
                small[p] = [p]
        for x, y, d in zip(a.tolist(), b.tolist(), distance.tolist(), strict=True):
            x, y = self.sets.find(x), self.sets.find(y)
            if x == y:
                continue
            density = min(most, 1 / max(d, 1e-6))
            self.sets.join(x, y)
            lead, total = min(x, y), self.size[x] + self.size[y]
            cx, cy = self.cluster.pop(x, -1), self.cluster.pop(y, -1)
            points = small.pop(x, []) + small.pop(y, [])
            self.size[lead] = total
            if cx >= 0 and cy >= 0:
                c = self.cluster[lead] = self._new()
                for child in (cx, cy):
                    self.parent[child], self.birth[child] = c, density
                    self.mass[c] += density * self.count[child]
                    self.count[c] += self.count[child]
                    if density * whole < 1 - 1e-9:
                        self.below[c] = max(self.below[c], 0.0) + max(self._stability(child), self.below[child], 0.0)
            elif cx >= 0 or cy >= 0 or total >= least_size:
                c = self.cluster[lead] = max(cx, cy) if cx >= 0 or cy >= 0 else self._new()
                for p in points:
                    self.inner[p], self.persistence[p] = c, density
                    self.mass[c] += density * self.start[p]
                    self.count[c] += self.start[p]
            else:
                small[lead] = points

    def _new(self) -> int:
        for values, first in ((self.mass, 0.0), (self.count, 0), (self.parent, -1), (self.birth, 0.0), (self.below, -1.0)):
            values.append(first)
        return len(self.mass) - 1

    def _stability(self, c: int) -> float:
        return self.mass[c] - self.count[c] * self.birth[c]

    def leaders(self) -> np.ndarray:
        return self.sets.leaders()

    def states(self, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Size, mass, worth of the children and whether there is a cluster, of the component of each point."""
        c = [self.cluster.get(x, -1) for x in lead.tolist()]
        pick = lambda values: np.array([values[i] if i >= 0 else 0.0 for i in c], float)
        return np.array([self.size[x] for x in lead.tolist()], np.int64), pick(self.mass), pick(self.below), np.array([i >= 0 for i in c], bool)

    def selected(self, lead: np.ndarray, above: list, persistence: list[float], names: list) -> tuple[list, list[float]]:
        """Selected cluster, or None, and persistence of each point; ``above`` and ``persistence`` are those that leaders got from heavier edges."""
        label: list = [None] * len(self.mass)
        named: dict[int, object] = {}
        for p, c in enumerate(self.inner.tolist()):  # points in the order of their names
            while c >= 0 and c not in named:
                named[c] = names[p]
                c = self.parent[c]
        for x, c in self.cluster.items():
            label[c] = above[x]
        for c in range(len(self.mass) - 1, -1, -1):  # parents come before their children
            if self.parent[c] >= 0:
                up = label[self.parent[c]]
                label[c] = up if up is not None else (named[c] if self.below[c] < 0 or self._stability(c) >= self.below[c] else None)
        out = [label[c] if c >= 0 else above[x] for c, x in zip(self.inner.tolist(), lead.tolist(), strict=True)]
        return out, [self.persistence[p] if c >= 0 else persistence[x] for p, (c, x) in enumerate(zip(self.inner.tolist(), lead.tolist(), strict=True))]


def cliques(vectors: np.ndarray, label: np.ndarray, least: float) -> np.ndarray:
    """Labels in which all pairs of a component reach ``least``; components where some do not are split.

    A component whose members all lie within half the angle of its mean direction needs no pairwise check. A split takes
    the row with the most partners (ties: the first) and adds its partners from the most similar on as long as all fit.
    """
    out, number = np.full(len(label), -1, np.int64), 0
    half = np.cos(np.arccos(least) / 2) + 1e-9
    order = np.argsort(label, kind="stable")
    for rows in np.split(order, np.nonzero(np.diff(label[order]))[0] + 1):
        if len(rows) < 2:
            continue
        v = vectors[rows]
        mean = v.mean(axis=0)
        norm = np.linalg.norm(mean)
        if norm > 0 and (v @ mean / norm >= half).all():
            out[rows], number = number, number + 1
            continue
        fits = np.round(v @ v.T, 6) >= least
        if fits.all():
            out[rows], number = number, number + 1
            continue
        left = np.ones(len(rows), bool)
        while left.any():
            degree = np.where(left, (fits & left[None]).sum(axis=1), -1)
            seed = int(degree.argmax())
            members = [seed]
            for x in np.argsort(-(v @ v[seed]), kind="stable").tolist():
                if x != seed and left[x] and fits[x, members].all():
                    members.append(x)
            left[members] = False
            if len(members) > 1:
                out[rows[members]], number = number, number + 1
    return out


def split_cliques(vectors: np.ndarray, degree: np.ndarray, least: float, tile: int = 1_024) -> np.ndarray:
    """The split of ``cliques`` for one component of any size: labels, -1 for rows without a partner.

    ``degree`` is the number of partners of each row, itself included. Similarities are computed in tiles, so that memory
    grows with the rows and not with their square.
    """
    n = len(vectors)
    out, left, degree, number = np.full(n, -1, np.int64), np.ones(n, bool), degree.copy(), 0
    while True:
        degree[~left] = -1
        seed = int(degree.argmax())
        if degree[seed] < 2:
            return out
        near = vectors @ vectors[seed]
        order = np.argsort(-near, kind="stable")
        order = order[left[order] & (np.round(near[order], 6) >= least) & (order != seed)]
        members = [seed]
        for begin in range(0, len(order), tile):
            part = order[begin : begin + tile]
            for b in range(0, len(members), tile):
                part = part[(np.round(vectors[part] @ vectors[members[b : b + tile]].T, 6) >= least).all(axis=1)]
            fits = np.round(vectors[part] @ vectors[part].T, 6) >= least
            fine, added = np.ones(len(part), bool), []
            for i in range(len(part)):
                if fine[i]:
                    added.append(i)
                    fine &= fits[i]
            members += part[added].tolist()
        left[members] = False
        rest = np.nonzero(left)[0]
        for begin in range(0, len(rest), tile):
            part = rest[begin : begin + tile]
            for b in range(0, len(members), tile):
                degree[part] -= (np.round(vectors[part] @ vectors[members[b : b + tile]].T, 6) >= least).sum(axis=1)
        if len(members) > 1:
            out[members], number = number, number + 1


def edge_cosines(vectors: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return cosines(vectors, vectors, a, b)
