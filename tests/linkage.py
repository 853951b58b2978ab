"""Plain agglomeration that tests compare with."""

import numpy as np


def naive_agglomerate(d: np.ndarray, threshold: float, linkage: str = "average", n_groups: int = 1) -> list[int]:
    """Always merge the closest pair of groups while its distance is below the threshold and more groups are left;
    each item's group, named by its smallest item."""
    clusters = {i: [i] for i in range(len(d))}
    while len(clusters) > n_groups:
        best = None
        keys = sorted(clusters)
        for ai, a in enumerate(keys):
            for b in keys[ai + 1:]:
                block = d[np.ix_(clusters[a], clusters[b])]
                v = block.mean() if linkage == "average" else block.max()
                if best is None or v < best[0] - 1e-15:
                    best = (v, a, b)
        if best[0] >= threshold:
            break
        _, a, b = best
        clusters[a] = clusters[a] + clusters.pop(b)
    lab = [0] * len(d)
    for k, members in clusters.items():
        for m in members:
            lab[m] = min(members)
    return lab
