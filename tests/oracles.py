"""Brute-force counterparts on plain Python lists, for small fixtures only."""

from __future__ import annotations

import math

import numpy as np


def topology_before(payments, us):
    """Directed edges and undirected contacts of the payments strictly before a time."""
    edges, contacts = set(), set()
    for p in payments:
        if p["kind"] == "payment" and p["event_us"] < us and p["source"] != p["destination"]:
            if p["source"] is None or p["destination"] is None:
                continue
            edges.add((p["source"], p["destination"]))
            contacts.add(tuple(sorted((p["source"], p["destination"]))))
    return edges, contacts


def component_of(contacts, node):
    near = {}
    for a, b in contacts:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    if node not in near:
        return set()
    seen, stack = {node}, [node]
    while stack:
        for other in near[stack.pop()]:
            if other not in seen:
                seen.add(other)
                stack.append(other)
    return seen


def exact_pagerank(edges, damping=0.85):
    nodes = sorted({n for e in edges for n in e})
    index = {n: i for i, n in enumerate(nodes)}
    size = len(nodes)
    matrix = np.zeros((size, size))
    for a, b in edges:
        matrix[index[b], index[a]] = 1
    out = matrix.sum(axis=0)
    for j in range(size):
        matrix[:, j] = matrix[:, j] / out[j] if out[j] else 1 / size
    solved = np.linalg.solve(np.eye(size) - damping * matrix, np.full(size, (1 - damping) / size))
    return dict(zip(nodes, solved))


def exact_ppr(contacts, start, damping=0.85):
    nodes = sorted({n for c in contacts for n in c})
    index = {n: i for i, n in enumerate(nodes)}
    size = len(nodes)
    matrix = np.zeros((size, size))
    for a, b in contacts:
        matrix[index[a], index[b]] = matrix[index[b], index[a]] = 1
    matrix = matrix / matrix.sum(axis=0)
    restart = np.zeros(size)
    restart[index[start]] = 1 - damping
    return dict(zip(nodes, np.linalg.solve(np.eye(size) - damping * matrix, restart)))


def snapshot_times(payments):
    times = sorted({p["event_us"] for p in payments})
    have, wanted, result = 0, 1, []
    for t in times:
        count = len(topology_before(payments, t)[0])
        if count >= wanted:
            have = count
            result.append((t, have))
            wanted = have + max(1, math.ceil(0.1 * have))
    return result


def adaptive(scores, alpha, eta, warmup):
    """Sequential cutoff: (decision, before, after) per score."""
    tau, learned, rows = None, [], []
    for s in scores:
        if tau is None:
            learned.append(s)
            if len(learned) >= warmup:
                tau = sorted(learned)[max(0, math.ceil((1 - alpha) * len(learned)) - 1)]
            rows.append(("LEARNING", None, tau))
            continue
        block = s > tau
        after = tau + eta * (block - alpha)
        rows.append(("BLOCK" if block else "ALLOW", tau, after))
        tau = after
    return rows


def frontier(rows):
    """Nondominated (fp, fn, blocks) of all cutoffs by trying every score, block-all and block-none."""
    points = set()
    for tau in {s for s, _ in rows} | {-1e-300}:
        blocked = [(s, y) for s, y in rows if s > tau]
        fp = sum(y == 0 for _, y in blocked)
        fn = sum(y == 1 for s, y in rows) - sum(y == 1 for _, y in blocked)
        points.add((fp, fn, len(blocked)))
    kept = {}
    for fp, fn, blocks in points:
        if any(a <= fp and b <= fn and (a < fp or b < fn) for a, b, _ in points):
            continue
        kept[(fp, fn)] = min(blocks, kept.get((fp, fn), blocks))
    return {(fp, fn, n) for (fp, fn), n in kept.items()}
