"""Pixel kernels in numpy, for use inside Arrow batches. Images are uint8 arrays (height, width[, 3], blue first).

Kernels named ``_each`` take a stack (n, height, width) of luma planes at once; the others of that name are theirs for one plane."""

from __future__ import annotations

import functools

import numpy as np


def luma(image: np.ndarray) -> np.ndarray:
    if image.ndim == 2:
        return image
    return np.rint(image[..., 0] * 0.114 + image[..., 1] * 0.587 + image[..., 2] * 0.299).astype(np.uint8)


@functools.lru_cache(256)
def _spread(n: int, m: int) -> np.ndarray:
    """(m, n) weights that average n samples into m."""
    w = np.zeros((m, n))
    for i in range(m):
        a, b = i * n / m, (i + 1) * n / m
        at = np.arange(n)
        w[i] = np.clip(np.minimum(at + 1, b) - np.maximum(at, a), 0, None)
    return w / w.sum(1, keepdims=True)


def area_resize(gray: np.ndarray, width: int, height: int) -> np.ndarray:
    return _spread(gray.shape[-2], height) @ gray.astype(float) @ _spread(gray.shape[-1], width).T


def difference_bits_each(grays: np.ndarray, size: int = 16) -> list[bytes]:
    small = area_resize(grays, size + 1, size)
    return [b.tobytes() for b in np.packbits((small[..., 1:] > small[..., :-1]).reshape(len(grays), -1), axis=1)]


def difference_bits(gray: np.ndarray, size: int = 16) -> bytes:
    return difference_bits_each(gray[None], size)[0]


def bits_distance(a: bytes, b: bytes) -> float:
    if not a or len(a) != len(b):
        return 1.0
    return (int.from_bytes(a) ^ int.from_bytes(b)).bit_count() / (8 * len(a))


def homography(quad: np.ndarray, width: int, height: int) -> np.ndarray:
    """From pixels of an upright width x height image to those of the quad (corners from top left, clockwise)."""
    rows, right = [], []
    for (u, v), (x, y) in zip([(0, 0), (width - 1, 0), (width - 1, height - 1), (0, height - 1)], quad):
        rows += [[u, v, 1, 0, 0, 0, -x * u, -x * v], [0, 0, 0, u, v, 1, -y * u, -y * v]]
        right += [x, y]
    return np.append(np.linalg.solve(np.array(rows, float), np.array(right, float)), 1.0).reshape(3, 3)


def bilinear(gray: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    h, w = gray.shape
    x, y = np.clip(x, 0, w - 1), np.clip(y, 0, h - 1)
    i, j = np.minimum(x.astype(int), max(w - 2, 0)), np.minimum(y.astype(int), max(h - 2, 0))
    fx, fy = x - i, y - j
    i1, j1 = np.minimum(i + 1, w - 1), np.minimum(j + 1, h - 1)
    g = gray.astype(float)
    return (g[j, i] * (1 - fx) + g[j, i1] * fx) * (1 - fy) + (g[j1, i] * (1 - fx) + g[j1, i1] * fx) * fy


def _bilinear_each(grays: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``bilinear`` of plane k at the points of row k."""
    n, h, w = grays.shape
    x, y = np.clip(x, 0, w - 1), np.clip(y, 0, h - 1)
    i, j = np.minimum(x.astype(int), max(w - 2, 0)), np.minimum(y.astype(int), max(h - 2, 0))
    fx, fy = x - i, y - j
    flat, at = grays.reshape(-1), j * w + i + (np.arange(n) * h * w)[:, None]
    right, below = int(w > 1), w * (h > 1)
    return (flat[at] * (1 - fx) + flat[at + right] * fx) * (1 - fy) + (flat[at + below] * (1 - fx) + flat[at + below + right] * fx) * fy


def upright_crop_each(grays: np.ndarray, quads: np.ndarray, height: int = 48) -> list[tuple[np.ndarray, np.ndarray]]:
    """The insides of quads (n, 4, 2), upright, at a given height: stacks of one width each, with the places of their planes in ``grays``."""
    side = lambda a, b: np.hypot(*np.moveaxis(quads[:, b] - quads[:, a], -1, 0))
    w, h = np.maximum(2.0, np.maximum(side(0, 1), side(3, 2))), np.maximum(2.0, np.maximum(side(0, 3), side(1, 2)))
    widths, out = np.maximum(2, np.rint(w * height / h)).astype(int), []
    for width in np.unique(widths).tolist():
        at = np.flatnonzero(widths == width)
        m = np.stack([homography(q, width, height) for q in quads[at]])
        v, u = np.mgrid[0:height, 0:width]
        p = m @ np.stack([u.ravel(), v.ravel(), np.ones(u.size)])
        out.append((at, np.rint(_bilinear_each(grays[at], p[:, 0] / p[:, 2], p[:, 1] / p[:, 2])).reshape(-1, height, width).astype(np.uint8)))
    return out


def upright_crop(gray: np.ndarray, quad: np.ndarray, height: int = 48) -> np.ndarray:
    """The quad's inside, upright, at a given height."""
    return upright_crop_each(gray[None], np.asarray(quad, float)[None], height)[0][1][0]


def quality_parts_each(grays: np.ndarray) -> list[tuple[float, float, float, float]]:
    g = grays.astype(float)
    p = np.pad(g, ((0, 0), (1, 1), (1, 1)), mode="reflect" if min(g.shape[1:]) > 1 else "edge")
    up, down, left, right = p[:, :-2, 1:-1], p[:, 2:, 1:-1], p[:, 1:-1, :-2], p[:, 1:-1, 2:]
    laplacian, size = up + down + left + right - 4 * g, g[0].size
    flat = lambda a: a.reshape(len(g), -1)
    edges = flat(np.abs(right - left) + np.abs(down - up) >= 110).sum(1)
    v, s, dark = flat(laplacian).var(1), flat(g).std(1), flat((grays <= 3) | (grays >= 252)).mean(1)
    return list(zip((v / (v + 200)).tolist(), (s / (s + 45)).tolist(), np.minimum(1.0, edges / max(0.18 * size, 1.0)).tolist(), np.minimum(1.0, 2 * dark).tolist()))


def quality_parts(gray: np.ndarray) -> tuple[float, float, float, float]:
    """(sharpness, contrast, completeness, occlusion)."""
    return quality_parts_each(gray[None])[0]


@functools.lru_cache(64)
def _hanning(h: int, w: int) -> np.ndarray:
    return np.outer(np.hanning(h), np.hanning(w))


def translation_each(before: np.ndarray, after: np.ndarray) -> list[tuple[float, float, float]]:
    h, w = min(before.shape[1], after.shape[1]), min(before.shape[2], after.shape[2])
    a, b = (np.fft.rfft2((x - x.mean((1, 2), keepdims=True)) * _hanning(h, w)) for x in (before[:, :h, :w].astype(float), after[:, :h, :w].astype(float)))
    cross = b * np.conj(a)
    r = np.fft.irfft2(cross / np.maximum(np.abs(cross), 1e-9), (h, w)).reshape(len(before), -1)
    y, x = np.divmod(r.argmax(1), w)
    return list(zip((x - w * (x > w // 2)).astype(float).tolist(), (y - h * (y > h // 2)).astype(float).tolist(), r.max(1).tolist()))


def translation(before: np.ndarray, after: np.ndarray) -> tuple[float, float, float]:
    """(dx, dy, peak) of the shift between two luma planes, by phase correlation."""
    return translation_each(before[None], after[None])[0]


def affine(before: np.ndarray, after: np.ndarray, blocks: int = 5, most_residual: float = 3.5, least_inliers: float = 0.45) -> tuple[np.ndarray, float]:
    """(2 x 3 matrix from points of the first luma plane to those of the second, share of blocks that agree with it). Each block's shift comes from phase
    correlation, after that of the whole frame; blocks that disagree are left out and the rest fitted again. Where too few agree, the frame's shift counts."""
    h, w = min(before.shape[0], after.shape[0]), min(before.shape[1], after.shape[1])
    dx, dy, _ = translation(before, after)
    whole = np.array([[1.0, 0.0, dx], [0.0, 1.0, dy]])
    size_y, size_x = h // blocks, w // blocks
    if min(size_y, size_x) < 16:
        return whole, 0.0
    at, to = [], []
    for y in range(0, h - size_y + 1, size_y):
        for x in range(0, w - size_x + 1, size_x):
            u, v = int(np.clip(x + dx, 0, w - size_x)), int(np.clip(y + dy, 0, h - size_y))
            a, b = before[y : y + size_y, x : x + size_x], after[v : v + size_y, u : u + size_x]
            if min(a.std(), b.std()) < 2.0:  # nothing to see
                continue
            sx, sy, peak = translation(a, b)
            if peak >= 0.05:
                at.append((x + size_x / 2, y + size_y / 2, 1.0))
                to.append((u + sx + size_x / 2, v + sy + size_y / 2))
    if len(at) < 6:
        return whole, 0.0
    p, q = np.array(at), np.array(to)
    m, on = whole, np.hypot(*(p @ whole.T - q).T) <= 4 * most_residual
    for _ in range(4):
        if on.sum() < 4:
            return whole, 0.0
        m = np.linalg.lstsq(p[on], q[on], rcond=None)[0].T
        on = np.hypot(*(p @ m.T - q).T) <= most_residual
    share = float(on.mean())
    return (m, share) if share >= least_inliers else (whole, 0.0)


def warped(gray: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """The plane moved by a 2 x 3 matrix; what comes from outside repeats the edge."""
    back = np.linalg.inv(np.vstack([matrix, [0.0, 0.0, 1.0]]))
    y, x = np.mgrid[0 : gray.shape[0], 0 : gray.shape[1]]
    u, v, _ = back @ np.stack([x.ravel(), y.ravel(), np.ones(x.size)])
    return np.rint(bilinear(gray, u, v)).reshape(gray.shape).astype(np.uint8)


def shifted(gray: np.ndarray, dx: float, dy: float) -> np.ndarray:
    y, x = np.mgrid[0 : gray.shape[0], 0 : gray.shape[1]]
    return np.rint(bilinear(gray, x - dx, y - dy)).astype(np.uint8)


def tile_scores(before: np.ndarray, after: np.ndarray, rows: int = 10, cols: int = 16, masked: np.ndarray | None = None) -> np.ndarray:
    """Mean change of each tile of a plane or of each plane of a stack, masked pixels being left out of the mean; a fully masked tile has 0."""
    if before.shape[-2:] != after.shape[-2:]:
        before = np.rint(area_resize(before, after.shape[-1], after.shape[-2]))
    delta = np.abs(after.astype(float) - before.astype(float))
    keep = np.ones(delta.shape[-2:]) if masked is None else (~masked).astype(float)
    y, x = _tiles(delta.shape[-2], rows), _tiles(delta.shape[-1], cols).T
    n = y @ keep @ x
    return np.where(n > 0, y @ (delta * keep) @ x / np.maximum(n, 1) / 255, 0.0)


@functools.lru_cache(64)
def _tiles(n: int, k: int) -> np.ndarray:
    """(k, n): which of n lines lie in each of k tiles."""
    edges = np.linspace(0, n, k + 1).astype(int)
    return ((np.arange(n) >= edges[:-1, None]) & (np.arange(n) < edges[1:, None])).astype(float)


def change_scopes(changed: np.ndarray, width: int, height: int) -> list[tuple[float, float, float, float]]:
    """Boxes of the groups of changed tiles, after growing each by a tile, padded by another and clamped to the frame."""
    rows, cols = changed.shape
    # tiles are bits of one number, a row being cols + 1 of them, so that no tile has a neighbour across the edge
    line, bits = cols + 1, 0
    for y, x in np.argwhere(changed).tolist():
        bits |= 1 << (y * line + x)
    frame = sum(((1 << cols) - 1) << (y * line) for y in range(rows))

    def grown(b: int) -> int:
        b |= b << 1 | b >> 1
        return (b | b << line | b >> line) & frame

    left, out = grown(bits), []
    while left:
        group, more = 0, left & -left
        while group != more:
            group, more = more, grown(more) & left
        left &= ~group
        ys = [y for y in range(rows) if group >> (y * line) & ((1 << cols) - 1)]
        columns = functools.reduce(lambda c, y: c | group >> (y * line) & ((1 << cols) - 1), ys, 0)
        low, high = (columns & -columns).bit_length() - 1, columns.bit_length() - 1
        out.append((max(0, low - 1) * width / cols, max(0, ys[0] - 1) * height / rows, min(cols, high + 2) * width / cols, min(rows, ys[-1] + 2) * height / rows))
    return out


def overflows(box: tuple[float, float, float, float], delta: np.ndarray, least: float = 0.08, share: float = 0.025) -> bool:
    """Does change reach beyond the box, in the bands above and below it or beside it?"""
    h, w = delta.shape
    left, top, right, bottom = box
    px, py = max(6.0, 0.35 * (right - left)), max(8.0, 1.0 * (bottom - top))
    x0, x1, y0, y1 = int(max(0, left - px)), int(min(w, right + px)), int(max(0, top - py)), int(min(h, bottom + py))
    hot = delta[y0:y1, x0:x1] >= least
    yy, xx = np.mgrid[y0:y1, x0:x1]
    inside_x, inside_y = (xx >= left) & (xx < right), (yy >= top) & (yy < bottom)
    bands = (inside_x & ~inside_y, inside_y & ~inside_x)
    return any(b.any() and hot[b].mean() >= share for b in bands)


# ---------------------------------------------------------------- convex quads


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise."""
    p = sorted(map(tuple, points.tolist()))
    if len(set(p)) < 3:
        return np.array(p)

    def half(ps):
        out: list[tuple[float, float]] = []
        for q in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]))


def polygon_area(p: np.ndarray) -> float:
    if len(p) < 3:
        return 0.0
    x, y = p[:, 0], p[:, 1]
    return abs(float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum())) / 2


def clipped(subject: np.ndarray, clip: np.ndarray) -> np.ndarray:
    """What two counter-clockwise convex polygons share."""
    out = subject.tolist()
    for a, b in zip(clip, np.roll(clip, -1, axis=0)):
        side = lambda q: (b[0] - a[0]) * (q[1] - a[1]) - (b[1] - a[1]) * (q[0] - a[0])  # noqa: B023, E731
        points, out = out, []
        for p, q in zip(points, points[1:] + points[:1]):
            sp, sq = side(p), side(q)
            if sp >= 0:
                out.append(p)
            if sp * sq < 0:
                f = sp / (sp - sq)
                out.append([p[0] + f * (q[0] - p[0]), p[1] + f * (q[1] - p[1])])
        if not out:
            return np.zeros((0, 2))
    return np.array(out)


def overlaps(a: np.ndarray, b: np.ndarray) -> tuple[float, float, float, float]:
    """(IoU, shared area over the smaller one, share of a that b covers, area of a) of the hulls of two polygons; all 0 where either has no area."""
    a, b = hull(a), hull(b)
    x, y = polygon_area(a), polygon_area(b)
    if x <= 0 or y <= 0:
        return 0.0, 0.0, 0.0, x
    both = polygon_area(clipped(a, b))
    share = lambda whole: min(1.0, both / max(whole, 1e-9))
    return share(x + y - both), share(min(x, y)), share(x), x


def _started(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quads (n, 4, 2) as ``hull`` gives them, from their least corner counter-clockwise, and which of them are strictly convex, so that this holds."""
    n = np.roll(p, -1, axis=1) - p
    turn = n[:, :, 0] * np.roll(n, -1, axis=1)[:, :, 1] - n[:, :, 1] * np.roll(n, -1, axis=1)[:, :, 0]
    size = np.abs(n).max((1, 2)) ** 2
    left, right = (turn > 1e-9 * size[:, None]).all(1), (turn < -1e-9 * size[:, None]).all(1)
    # four turns to one side make one round or two; the diagonals of two rounds do not part their corners
    across = lambda i: n[:, i, 0] * (p[:, i - 1, 1] - p[:, i, 1]) - n[:, i, 1] * (p[:, i - 1, 0] - p[:, i, 0])
    convex = left & np.all([across(i) > 0 for i in range(4)], 0) | right & np.all([across(i) < 0 for i in range(4)], 0)
    p = np.where(right[:, None, None], p[:, ::-1], p)
    x, y = p[:, :, 0], p[:, :, 1]
    first = np.where(x == x.min(1, keepdims=True), y, np.inf).argmin(1)
    return np.take_along_axis(p, ((first[:, None] + np.arange(4)) % 4)[:, :, None], 1), convex


def _area_each(p: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Areas of polygons (k, m, 2) of which the first n corners count."""
    at = np.arange(p.shape[1])
    follow = np.take_along_axis(p, np.where(at + 1 < n[:, None], at + 1, 0)[:, :, None], 1)
    terms = p[:, :, 0] * follow[:, :, 1] - follow[:, :, 0] * p[:, :, 1]
    return np.where(n >= 3, np.abs(np.where(at < n[:, None], terms, 0.0).sum(1)) / 2, 0.0)


def overlaps_each(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``overlaps`` of each pair of quads (n, 4, 2), as (n, 4): convex ones are clipped together, others one by one."""
    (p, fine), (q, too) = _started(a), _started(b)
    out = np.zeros((len(a), 4))
    for i in np.flatnonzero(~(fine & too)).tolist():
        out[i] = overlaps(a[i], b[i])
    at = np.flatnonzero(fine & too)
    if not len(at):
        return out
    p, q = p[at], q[at]
    four = np.full(len(at), 4)
    x, y = _area_each(p, four), _area_each(q, four)
    n, corners = four, np.concatenate([p, np.zeros_like(p)], 1)  # each of four cuts adds a corner at most
    for i in range(4):
        c, d = q[:, i, None], q[:, (i + 1) % 4, None]
        held = np.arange(8) < n[:, None]
        follow = np.take_along_axis(corners, np.where(np.arange(8) + 1 < n[:, None], np.arange(8) + 1, 0)[:, :, None], 1)
        side = lambda z: (d[:, :, 0] - c[:, :, 0]) * (z[:, :, 1] - c[:, :, 1]) - (d[:, :, 1] - c[:, :, 1]) * (z[:, :, 0] - c[:, :, 0])  # noqa: B023, E731
        s, t = side(corners), side(follow)
        stay, cut = held & (s >= 0), held & (s * t < 0)
        f = s / np.where(cut, s - t, 1.0)
        points = np.stack([corners, corners + f[:, :, None] * (follow - corners)], 2).reshape(len(at), 16, 2)
        keep = np.stack([stay, cut], 2).reshape(len(at), 16)
        n = keep.sum(1)
        order = np.argsort(~keep, axis=1, kind="stable")[:, :8]
        corners = np.take_along_axis(points, order[:, :, None], 1)
    both = _area_each(corners, n)
    share = lambda whole: np.minimum(1.0, both / np.maximum(whole, 1e-9))
    out[at] = np.stack([share(x + y - both), share(np.minimum(x, y)), share(x), x], 1)
    return out


def quad_iou(a: np.ndarray, b: np.ndarray) -> float:
    a, b = hull(a), hull(b)
    x, y = polygon_area(a), polygon_area(b)
    if x <= 0 or y <= 0:
        return 0.0
    both = polygon_area(clipped(a, b))
    return min(1.0, max(0.0, both / max(x + y - both, 1e-9)))
