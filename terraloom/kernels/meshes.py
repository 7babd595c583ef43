"""Winding and simplification of one indexed mesh."""

from __future__ import annotations

import heapq

import numpy as np


def consistent_winding(tri: np.ndarray) -> np.ndarray:
    """Triangles of each component turned to agree with its majority.

    Two triangles agree if they run along their common edge in opposite directions.
    Edges of more than two triangles join nothing.
    """
    parent, turned = list(range(len(tri))), [0] * len(tri)

    def find(i: int) -> tuple[int, int]:
        path, p = [], 0
        while parent[i] != i:
            path.append(i)
            i = parent[i]
        for k in reversed(path):  # parity to the root, from the root's side
            p ^= turned[k]
            parent[k], turned[k] = i, p
        return i, p

    edges: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for f, t in enumerate(tri.tolist()):
        for a, b in zip(t, t[1:] + t[:1], strict=True):
            edges.setdefault((min(a, b), max(a, b)), []).append((f, int(a < b)))
    for own in edges.values():
        if len(own) == 2:
            (f, d), (g, e) = own
            (rf, pf), (rg, pg) = find(f), find(g)
            if rf != rg:
                parent[rg], turned[rg] = rf, pf ^ pg ^ int(d == e)
    roots = [find(f) for f in range(len(tri))]
    votes: dict[int, list[int]] = {}
    for r, p in roots:
        votes.setdefault(r, [0, 0])[p] += 1
    out = tri.copy()
    for f, (r, p) in enumerate(roots):
        if p == int(votes[r][1] <= votes[r][0]):
            out[f] = tri[f][::-1]
    return out


def simplified(xyz: np.ndarray, tri: np.ndarray, target: float, error: float, lock_border: bool = True) -> np.ndarray:
    """Triangles after edge collapses by least quadric error; vertices keep their numbers.

    Stops at ``target`` times the triangles, or where the next collapse would be farther
    than ``error`` times the extent from the planes it replaces.  A collapse moves one
    end onto the other, never turns a triangle over, and with ``lock_border`` never
    moves a vertex of a border edge.
    """
    if error <= 0 or not len(tri):
        return tri
    extent = float(np.ptp(xyz, axis=0).max()) or 1.0
    limit = (error * extent) ** 2
    q = np.zeros((len(xyz), 4, 4))
    a, b, c = (xyz[tri[:, k]] for k in range(3))
    n = np.cross(b - a, c - a)
    size = np.linalg.norm(n, axis=1)
    n = n / np.maximum(size, 1e-300)[:, None]
    plane = np.concatenate([n, -(n * a).sum(1)[:, None]], 1)
    outer = plane[:, :, None] * plane[:, None, :]
    for k in range(3):
        np.add.at(q, tri[:, k], outer)
    alive = {f: tuple(t) for f, t in enumerate(tri.tolist())}
    faces: list[set[int]] = [set() for _ in xyz]
    count: dict[tuple[int, int], int] = {}
    for f, t in alive.items():
        for i, v in enumerate(t):
            faces[v].add(f)
            e = tuple(sorted((v, t[(i + 1) % 3])))
            count[e] = count.get(e, 0) + 1
    border = {v for e, k in count.items() if k == 1 for v in e} if lock_border else set()
    stamp = [0] * len(xyz)

    def cost(u: int, v: int) -> float:
        p = np.append(xyz[v], 1.0)
        return float(p @ (q[u] + q[v]) @ p)

    heap: list[tuple[float, int, int, int, int]] = []

    def push(u: int, v: int) -> None:
        if u not in border:
            heapq.heappush(heap, (cost(u, v), u, v, stamp[u], stamp[v]))

    for u, v in count:
        push(u, v)
        push(v, u)
    want = max(int(target * len(tri)), 1)
    while heap and len(alive) > want:
        d, u, v, su, sv = heapq.heappop(heap)
        if d > limit:
            break
        if stamp[u] != su or stamp[v] != sv or not faces[u] or not faces[v]:
            continue
        keep = [f for f in faces[u] if v not in alive[f]]
        ring = {w for f in faces[u] for w in alive[f]} & {w for f in faces[v] for w in alive[f]} - {u, v}
        if len(ring) > 2:
            continue  # the surface would pinch
        moved = []
        for f in keep:
            t = tuple(v if w == u else w for w in alive[f])
            old = np.cross(xyz[alive[f][1]] - xyz[alive[f][0]], xyz[alive[f][2]] - xyz[alive[f][0]])
            new = np.cross(xyz[t[1]] - xyz[t[0]], xyz[t[2]] - xyz[t[0]])
            if old @ new <= 0:
                break
            moved.append((f, t))
        if len(moved) < len(keep):
            continue
        for f in list(faces[u]):
            for w in alive[f]:
                faces[w].discard(f)
            del alive[f]
        for f, t in moved:
            alive[f] = t
            for w in t:
                faces[w].add(f)
        q[v] += q[u]
        stamp[u] += 1
        stamp[v] += 1
        for w in {w for f in faces[v] for w in alive[f]} - {v}:
            push(v, w)
            push(w, v)
    return np.array([alive[f] for f in sorted(alive)], tri.dtype).reshape(-1, 3)
