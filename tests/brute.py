"""Ward's and HDBSCAN's hierarchies of weighted points in memory, to hold the operators against."""

import numpy as np

NOISE = -1


def ward_labels(centre: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """Cluster of each weighted point when Ward's merges, cheapest first, have left ``k`` clusters.

    Merges are found along chains of nearest neighbours, which gives Ward's own tree: a merge never
    brings two other clusters nearer than they were. Memory is that of the points.
    """
    n = len(centre)
    c, w, live = centre.astype(float).copy(), weight.astype(float).copy(), np.ones(n, bool)
    merges, chain = [], []
    while len(merges) < n - 1:
        if not chain:
            chain = [int(live.argmax())]
        while True:
            a = chain[-1]
            cost = ((c - c[a]) ** 2).sum(1) * w * w[a] / (w + w[a])
            cost[~live], cost[a] = np.inf, np.inf
            b = int(cost.argmin())
            if len(chain) > 1 and cost[chain[-2]] <= cost[b]:
                b = chain[-2]
                break
            chain.append(b)
        del chain[-2:]
        a, b = min(a, b), max(a, b)
        merges.append((float(((c[a] - c[b]) ** 2).sum() * w[a] * w[b] / (w[a] + w[b])), a, b))
        c[a] = (c[a] * w[a] + c[b] * w[b]) / (w[a] + w[b])
        w[a] += w[b]
        live[b] = False
    label = np.arange(n)
    for _, a, b in sorted(merges, key=lambda m: m[0])[: max(0, n - max(1, k))]:
        label[label == label[b]] = label[a]
    return label


def density_clusters(centre: np.ndarray, weight: np.ndarray, least_size: float, neighbours: float) -> tuple[np.ndarray, np.ndarray]:
    """HDBSCAN of weighted points: label (-1: noise) and membership (0 to 1) of each.

    Core distance: to where ``neighbours`` other rows are reached. The tree of mutual reachability is
    condensed to clusters of ``least_size`` rows, of which the most stable are taken, never the root.
    """
    m = len(centre)
    gaps = np.stack([np.sqrt(((centre - c) ** 2).sum(1)) for c in centre])
    order = np.argsort(gaps, axis=1, kind="stable")
    reached = np.cumsum(weight[order], axis=1) - 1
    at = np.minimum((reached < neighbours).sum(1), m - 1)
    core = gaps[np.arange(m), order[np.arange(m), at]]
    reach = np.maximum(gaps, np.maximum(core[:, None], core[None]))
    # The spanning tree of least reach, equal ones by their numbers, then its merges from the nearest up.
    low, high = np.triu_indices(m, 1)
    pairs = np.lexsort((high, low, reach[low, high]))
    edges, part = [], np.arange(m)
    members = {i: [i] for i in range(m)}
    for a, b in zip(low[pairs].tolist(), high[pairs].tolist(), strict=True):
        if part[a] != part[b]:
            x, y = sorted((part[a], part[b]), key=lambda p: len(members[p]))
            part[members[x]] = y
            members[y] += members.pop(x)
            edges.append((reach[a, b], a, b))
            if len(edges) == m - 1:
                break
    top, children, total = list(range(2 * m - 1)), {}, list(weight) + [0.0] * (m - 1)

    def root(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for i, (gap, a, b) in enumerate(edges):
        a, b = root(a), root(b)
        children[m + i] = (a, b, 1 / max(gap, 1e-12))
        total[m + i] = total[a] + total[b]
        top[a] = top[b] = m + i
    # Condense from the root: a cluster lives until it splits in two large parts; points leave it on the way.
    parent, born, stable, left = {0: -1}, {0: 0.0}, {0: 0.0}, {}
    stack = [(2 * m - 2, 0)]
    while stack:
        node, own = stack.pop()
        if node < m:
            left.setdefault(node, (own, born[own]))
            continue
        a, b, density = children[node]
        large = [x for x in (a, b) if total[x] >= least_size]
        for x in (a, b):
            if len(large) == 2:
                stable[own] += (density - born[own]) * total[x]
                new = len(parent)
                parent[new], born[new], stable[new] = own, density, 0.0
                stack.append((x, new))
            elif x in large:
                stack.append((x, own))
            else:
                stable[own] += (density - born[own]) * total[x]
                inside = [x]
                while inside:
                    y = inside.pop()
                    if y < m:
                        left[y] = (own, density)
                    else:
                        inside.extend(children[y][:2])
    chosen = {c: True for c in parent}
    for c in sorted(parent, reverse=True):
        below = [x for x in parent if parent[x] == c]
        inner = sum(stable[x] for x in below)
        if c == 0 or (below and inner > stable[c]):
            chosen[c], stable[c] = False, max(inner, stable[c] if c == 0 else inner)
        else:
            inside = below
            while inside:
                chosen.update(dict.fromkeys(inside, False))
                inside = [x for x in parent if parent[x] in inside]
    label, density = np.full(m, NOISE), np.zeros(m)
    for point, (own, level) in left.items():
        while own != -1 and not chosen[own]:
            own = parent[own]
        label[point], density[point] = own, level
    names = {c: i for i, c in enumerate(sorted({x for x in label if x != NOISE}, key=lambda c: (-weight[label == c].sum(), c)))}
    most = {c: density[label == c].max() for c in names}
    member = np.array([min(1.0, density[i] / most[c]) if c != NOISE else 0.0 for i, c in enumerate(label)])
    return np.array([names.get(c, NOISE) for c in label]), member
