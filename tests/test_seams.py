"""Seams on a whole table against plain loops over the pieces of each image."""

import math
from collections import defaultdict

from fiberlake.operators import pipeline, seams
from fiberlake.plans.fiber_queries import traced


def ends_of(f):
    for e, at, inner in ((0, f.points[0], f.points[1]), (1, f.points[-1], f.points[-2])):
        n = math.hypot(at.x - inner.x, at.y - inner.y)
        yield e, at.x, at.y, *(((at.x - inner.x) / n, (at.y - inner.y) / n) if n else (0.0, 0.0))


def links(pieces, tol=6.0, angle=45.0):
    """Ends that are each other's nearest, in rounds; pieces of one tile meet once one of them is joined."""
    ends = [(f, *e) for f in pieces for e in ends_of(f)]
    left = []
    for f, e, x, y, ux, uy in ends:
        for h, k, p, q, vx, vy in ends:
            gap = math.hypot(p - x, q - y)
            if f.fiber_id < h.fiber_id and gap <= tol and ux * vx + uy * vy <= -math.cos(math.radians(angle)):
                left.append((gap, f.fiber_id, e, h.fiber_id, k, f.tile_id == h.tile_id))
    taken, joined = [], set()
    while True:
        best = {}
        for c in sorted(c for c in left if not c[5] or c[1] in joined or c[3] in joined):
            best.setdefault(c[1:3], c)
            best.setdefault(c[3:5], c)
        mutual = {c for c in best.values() if best[c[1:3]] == c == best[c[3:5]]}
        if not mutual:
            return taken
        taken += mutual
        used = {s for c in mutual for s in (c[1:3], c[3:5])}
        joined |= {f for f, _ in used}
        left = [c for c in left if c[1:3] not in used and c[3:5] not in used]


def chains(pieces):
    """(id, tile, points) of every fibre once its pieces are joined."""
    by_id, to = {f.fiber_id: f for f in pieces}, {}
    for gap, a, e, b, k, _ in links(pieces):
        to[a, e], to[b, k] = (b, k, gap), (a, e, gap)

    def walk(f, enter):
        """Sides (fibre, entered end) on the way from here; comes back to the first one in a cycle."""
        out = [(f, enter)]
        while (f, 1 - enter) in to:
            f, enter, _ = to[f, 1 - enter]
            if (f, enter) == out[0]:
                return out, True
            out.append((f, enter))
        return out, False

    for f in by_id:  # a cycle opens at its longest gap
        way, closed = walk(f, 0)
        if closed:
            gaps = [(to[g, 1 - e][2], tuple(sorted([(g, 1 - e), to[g, 1 - e][:2]]))) for g, e in way]
            for end in max(gaps)[1]:
                del to[end]
    seen = set()
    for f in sorted(by_id):
        for enter in (0, 1):
            if f in seen or (f, enter) in to:
                continue
            way, _ = walk(f, enter)
            seen |= {g for g, _ in way}
            points = []
            for g, e in way:
                p = [(v.x, v.y) for v in by_id[g].points][:: -1 if e else 1]
                points += p[1:] if points and max(abs(points[-1][0] - p[0][0]), abs(points[-1][1] - p[0][1])) < 1e-6 else p
            yield f, by_id[f].tile_id, tuple(points)


def kept(pieces, tol=4.0):
    """From the longest, those without a longer one of another tile that stays, near and alike."""
    out = []
    for f in sorted(pieces, key=lambda f: (-f.length_arc, f.fiber_id)):
        turn = lambda h: min((f.angle - h.angle) % 180, (h.angle - f.angle) % 180)
        if not any(h.tile_id != f.tile_id and math.hypot(h.center.x - f.center.x, h.center.y - f.center.y) <= tol and turn(h) <= 20 and h.length_arc > 0 and f.length_arc / h.length_arc >= 0.5 for h in out):
            out.append(f)
    return out


def images(rows):
    out = defaultdict(list)
    for r in rows:
        out[r.image_id].append(r)
    return out


def test_stitching_a_table(spark, sf):
    f = traced(spark, sf)
    got = sorted((r.image_id, r.fiber_id, r.tile_id, tuple((p.x, p.y) for p in r.points)) for r in seams.stitch_fibers(f).collect())
    rows = f.collect()
    want = sorted((i, *c) for i, pieces in images(rows).items() for c in chains(pieces))
    assert got == want and len(want) < len(rows) - 20


def test_post_processing_a_table(spark, sf):
    f = traced(spark, sf)
    got = sorted((r.image_id, r.fiber_id, tuple((p.x, p.y) for p in r.points)) for r in pipeline.postprocess(f).collect())
    want = []
    for i, pieces in images(f.collect()).items():
        want += [(i, n, c[2]) for n, c in enumerate(sorted(chains(kept(pieces)), key=lambda c: (c[1], c[0])))]
    assert got == sorted(want)
