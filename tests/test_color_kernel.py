"""Colour signatures: products in short numbers rule most pairs out, what they leave is looked at in full."""

import math

import numpy as np

from curaspark.operators import blocks as B


def _plain(a, b, limit, matches, linked):
    out = {}
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            apart = [math.sqrt(sum((x[p + k] - y[p + k]) ** 2 for k in range(3))) for p in range(0, len(x), 3)]
            near = [d < limit for d in apart]
            if sum(near) >= matches and sum(p and q for p, q in zip(near, near[1:])) >= linked:
                out[i, j] = sum(int(d) for d in apart)
    return out


def _looked_at(monkeypatch, run):
    """What ``run`` gives, and the pairs whose differences are rooted."""
    rooted, root = [], np.sqrt
    monkeypatch.setattr(B.np, "sqrt", lambda x: rooted.append(np.size(x)) or root(x))
    out = run()
    monkeypatch.undo()
    return out, sum(rooted)


def test_few_pairs_are_looked_at_in_full(monkeypatch):
    rng = np.random.default_rng(8)
    places = 21
    for matches, linked, spread in ((21, 20, 12.0), (14, 8, 16.0)):
        a, b = rng.standard_normal((80, places * 3)) * spread, rng.standard_normal((70, places * 3)) * spread
        b[:5] = a[:5]
        b[5, :3], a[9, 4] = a[5, :3] + [24, 32, 0], np.nan  # a distance at the limit itself, and no number
        found, rooted = _looked_at(monkeypatch, lambda: list(B.color_kernel(40, matches, linked, None)(a, b, 0)))  # noqa: B023
        got = {(int(i), int(j)): s for r, c, scores in found for i, j, s in zip(r, c, scores)}
        wanted = _plain(a[[i for i in range(80) if i != 9]], b, 40, matches, linked)
        wanted = {(i + (i >= 9), j): s for (i, j), s in wanted.items()}
        got = {k: s for k, s in got.items() if k[0] != 9}
        assert got == wanted and len(wanted) >= 5
        if matches == places:
            assert rooted < len(a) * len(b) * places / 4
