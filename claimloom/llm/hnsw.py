"""A hierarchical navigable small-world graph over one shard of vectors, in flat arrays.

Level 0 holds all vectors, each higher level a random 1/``LINKS`` of the one below.  A level is
built by insertion: its vectors come in blocks, those of higher levels first; a block's
vectors descend from the top, search the level as it is with a beam, and meet each other.  Of
what it finds a vector links those that are nearer to it than to any one linked before, which
spreads links over directions.  Links are mutual; a vertex with too many keeps a spread of them.
Search descends greedily to level 0 and goes on there with a beam, for a block of queries at once.

Nearness is the inner product.  Vectors get one more component that gives all of a shard the
same length, so the nearest by angle are those of largest inner product.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LINKS = 16
#: Nearest found of which an inserted vector picks its links.
CANDIDATES = 64
BEAM = 128
#: Vertices that each query opens at a time.
OPEN = 4
BLOCK = 512


def _levels(n: int, rng: np.random.Generator) -> np.ndarray:
    return np.minimum(np.floor(-np.log(1 - rng.random(n)) / np.log(LINKS)).astype(np.int8), 12)


def _spread(x: np.ndarray, rows: np.ndarray, near: np.ndarray, keep: int, block: int = 256) -> np.ndarray:
    """Of each row's candidates (nearest first, -1 fills up) those to link; -1 fills up."""
    out = np.full((len(rows), keep), -1, np.int32)
    for at in range(0, len(rows), block):
        own = near[at : at + block]
        vec = x[own]
        to_row = np.einsum("bcd,bd->bc", vec, x[rows[at : at + block]])
        among = np.matmul(vec, vec.transpose(0, 2, 1))
        chosen = np.zeros(own.shape, bool)
        for c in range(own.shape[1]):
            worse = (chosen & (among[:, c] > to_row[:, c, None])).any(axis=1)
            chosen[:, c] = ~worse & (own[:, c] >= 0) & (chosen.sum(axis=1) < keep)
        # kept ones first, then the nearest others
        order = np.argsort(np.where(own < 0, 2, ~chosen), axis=1, kind="stable")[:, :keep]
        out[at : at + block, : order.shape[1]] = np.take_along_axis(own, order, 1)
    return out


def _ragged(first: np.ndarray, second: np.ndarray, score: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs as (distinct first, matrix of their second by falling score, at most ``most``; -1 fills up)."""
    order = np.lexsort((second, -score, first))
    first, second = first[order], second[order]
    keys, starts = np.unique(first, return_index=True)
    rank = np.arange(len(first)) - np.repeat(starts, np.diff(np.append(starts, len(first))))
    out = np.full((len(keys), min(most, int(rank.max(initial=-1)) + 1)), -1, np.int32)
    ok = rank < most
    out[np.searchsorted(keys, first[ok]), rank[ok]] = second[ok]
    return keys, out


def _descend(x: np.ndarray, links: np.ndarray, q: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Each query's place after going on to the nearest neighbour for as long as one is nearer."""
    best = np.einsum("qd,qd->q", q, x[at])
    going = np.arange(len(q))
    at = at.copy()
    while len(going):
        near = links[at[going]]
        sim = np.einsum("qd,qcd->qc", q[going], x[near])
        sim[near < 0] = -np.inf
        top = sim.argmax(axis=1)
        better = sim[np.arange(len(going)), top] > best[going]
        going, near, top, sim = going[better], near[better], top[better], sim[better]
        at[going], best[going] = near[np.arange(len(going)), top], sim[np.arange(len(going)), top]
    return at


def _beam(x: np.ndarray, links: np.ndarray, q: np.ndarray, at: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, scores) of the nearest ``beam`` found from a start each, in no order; -1 fills up."""
    n, m = len(x), len(q)
    beam = min(beam, n)
    found = np.full((m, beam), -1, np.int64)
    score = np.full((m, beam), -np.inf, np.float32)
    opened = np.zeros((m, beam), bool)
    found[:, 0], score[:, 0] = at, np.einsum("qd,qd->q", q, x[at])
    seen = np.zeros((m, n + 1), bool)
    seen[:, n] = True  # stands for the filler -1
    seen[np.arange(m), at] = True
    going = np.arange(m)
    while len(going):
        ready = np.where(opened[going] | (found[going] < 0), -np.inf, score[going])
        top = np.argpartition(-ready, OPEN - 1, axis=1)[:, :OPEN] if ready.shape[1] > OPEN else np.tile(np.arange(ready.shape[1]), (len(going), 1))
        can = np.take_along_axis(ready, top, 1) > -np.inf
        still = can.any(axis=1)
        going, top, can = going[still], top[still], can[still]
        if not len(going):
            break
        opened[going[:, None], top] |= can
        near = links[found[going[:, None], top]]
        near = np.where(can[:, :, None], near, -1).reshape(len(going), -1).astype(np.int64)
        near[near < 0] = n
        near.sort(axis=1)
        fresh = ~seen[going[:, None], near]
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        seen[going[:, None], near] = True
        sim = np.full(near.shape, -np.inf, np.float32)
        a, b = np.nonzero(fresh)
        sim[a, b] = np.einsum("ed,ed->e", q[going[a]], x[near[a, b]])
        near[~fresh] = -1
        all_id = np.concatenate([found[going], near], axis=1)
        all_sim = np.concatenate([score[going], sim], axis=1)
        all_open = np.concatenate([opened[going], np.zeros(near.shape, bool)], axis=1)
        pick = np.argpartition(-all_sim, beam - 1, axis=1)[:, :beam]
        found[going], score[going], opened[going] = (np.take_along_axis(v, pick, 1) for v in (all_id, all_sim, all_open))
    return found, score


def _insert(x: np.ndarray, links: np.ndarray, block: np.ndarray, starts: np.ndarray | None) -> None:
    """Link a block of rows into a level; ``starts`` are rows there already, None for the first block."""
    q = x[block]
    own = q @ q.T
    np.fill_diagonal(own, -np.inf)
    k = min(CANDIDATES, len(block) - 1)
    top = np.argpartition(-own, k - 1, axis=1)[:, :k] if k else np.zeros((len(block), 0), np.int64)
    near, sim = block[top], np.take_along_axis(own, top, 1)
    if starts is not None:
        old, old_sim = _beam(x, links, q, starts, CANDIDATES)
        near, sim = np.concatenate([near, old], axis=1), np.concatenate([sim, old_sim], axis=1)
    order = np.argsort(-sim, axis=1, kind="stable")[:, :CANDIDATES]
    picked = _spread(x, block, np.take_along_axis(near, order, 1).astype(np.int32), LINKS)
    a, b = np.repeat(block, picked.shape[1]), picked.ravel()
    a, b = a[b >= 0], b[b >= 0]
    touched = np.unique(np.concatenate([a, b]))
    held = links[touched]
    c, d = np.repeat(touched, held.shape[1]), held.ravel()
    c, d = c[d >= 0], d[d >= 0]
    pairs = np.unique(np.concatenate([a.astype(np.int64) << 32 | b, b.astype(np.int64) << 32 | a, c.astype(np.int64) << 32 | d]))
    a, b = pairs >> 32, pairs & 0xFFFFFFFF
    most = links.shape[1]
    keys, all_near = _ragged(a, b, np.einsum("ed,ed->e", x[a], x[b]), 2 * most)
    links[keys, :] = -1
    links[keys, : min(most, all_near.shape[1])] = all_near[:, :most]
    if all_near.shape[1] > most:
        full = all_near[:, most] >= 0
        links[keys[full]] = _spread(x, keys[full], all_near[full], most)


@dataclass
class Graph:
    """ids and vectors by row; for each level its rows and their neighbours as rows, flat."""

    ids: np.ndarray  # (n,) int64
    vectors: np.ndarray  # (n, d) as given
    members: list[np.ndarray]  # rows on each level, ascending
    neighbours: list[np.ndarray]  # (members, links) rows, -1 fills up

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray, seed: int = 1) -> Graph:
        x = _lift(vectors)
        n = len(x)
        rng = np.random.default_rng(seed)
        level = _levels(n, rng)
        order = np.lexsort((rng.random(n), -level)).astype(np.int32)  # higher levels first
        members, tables = [], []
        for top in range(int(level.max(initial=0)), -1, -1):
            rows = order[: int((level >= top).sum())]
            links = np.full((n, LINKS * 2 if top == 0 else LINKS), -1, np.int32)
            done = 0
            while done < len(rows):
                block = rows[done : done + (BLOCK if done >= BLOCK else max(done, 64))]
                starts = None
                if done:
                    starts = np.full(len(block), order[0], np.int64)
                    for upper in tables:
                        starts = _descend(x, upper, x[block], starts)
                _insert(x, links, block, starts)
                done += len(block)
            tables.append(links)
            members.append(np.sort(rows))
        return cls(ids, vectors, members[::-1], [t[m] for t, m in zip(tables, members, strict=True)][::-1])

    def _table(self, level: int) -> np.ndarray:
        """A level's neighbours by row of the shard."""
        rows, links = self.members[level], self.neighbours[level]
        if len(rows) == len(self.ids):
            return links
        out = np.full((len(self.ids), links.shape[1]), -1, np.int32)
        out[rows] = links
        return out

    def search(self, queries: np.ndarray, k: int, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) of each query's ``k`` nearest found, scores in double precision."""
        tables = [self._table(i) for i in range(len(self.members))]
        x = self.vectors.astype(np.float32)
        parts = [self._block(x, tables, queries[at : at + BLOCK], at, k, max(beam, k)) for at in range(0, len(queries), BLOCK)]
        return tuple(np.concatenate(p) for p in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def _block(self, x: np.ndarray, tables: list[np.ndarray], queries: np.ndarray, first: int, k: int, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q = queries.astype(np.float32)
        if beam >= len(x):  # the beam takes all, so there is nothing to walk
            found = np.tile(np.arange(len(x)), (len(q), 1))
        else:
            at = np.full(len(q), self.members[-1][0], np.int64)
            for links in tables[:0:-1]:
                at = _descend(x, links, q, at)
            found, score = _beam(x, tables[0], q, at, beam)
            # rounding in single precision cannot part what is to be ranked among twice as many
            if beam > 4 * k:
                top = np.argpartition(-score, 2 * k, axis=1)[:, : 2 * k + 1]
                found = np.take_along_axis(found, top, 1)
        exact = np.einsum("qd,qbd->qb", queries.astype(np.float64), self.vectors[np.maximum(found, 0)].astype(np.float64))
        exact[found < 0] = -np.inf
        ids = np.where(found < 0, np.iinfo(np.int64).max, self.ids[np.maximum(found, 0)])
        order = np.lexsort((ids, -exact), axis=1)[:, :k]
        ids, exact, real = (np.take_along_axis(v, order, 1) for v in (ids, exact, found >= 0))
        who = np.repeat(np.arange(first, first + len(q)), order.shape[1]).reshape(order.shape)
        return who[real], ids[real], exact[real]

    def to_row(self) -> dict:
        sizes = [len(r) for r in self.members]
        return {
            "ids": self.ids.astype("<i8").tobytes(),
            "vectors": self.vectors.tobytes(),
            "kind": self.vectors.dtype.str,
            "sizes": sizes,
            "members": np.concatenate(self.members).astype("<i4").tobytes(),
            "neighbours": np.concatenate([v.ravel() for v in self.neighbours]).astype("<i4").tobytes(),
        }

    @classmethod
    def from_row(cls, row) -> Graph:
        ids = np.frombuffer(row["ids"], "<i8")
        vectors = np.frombuffer(row["vectors"], row["kind"]).reshape(len(ids), -1)
        sizes = list(row["sizes"])
        members = np.split(np.frombuffer(row["members"], "<i4"), np.cumsum(sizes)[:-1])
        widths = [LINKS * 2, *[LINKS] * (len(sizes) - 1)]
        flat = np.split(np.frombuffer(row["neighbours"], "<i4"), np.cumsum([s * w for s, w in zip(sizes, widths, strict=True)])[:-1])
        return cls(ids, vectors, members, [f.reshape(s, w) for f, s, w in zip(flat, sizes, widths, strict=True)])


def _lift(vectors: np.ndarray) -> np.ndarray:
    """One more component, so that all have the length of the longest."""
    x = vectors.astype(np.float64)
    square = (x * x).sum(axis=1)
    return np.concatenate([x, np.sqrt(np.maximum(square.max(initial=0) - square, 0))[:, None]], axis=1).astype(np.float32)
