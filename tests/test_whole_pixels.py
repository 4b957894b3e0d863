from glyphstream.plans import stateful
from glyphstream.sources.adapters import observations

DATA = "/root/testdata/sf0.001"


def test_pixel_pipeline_reads_every_observation(spark):
    got = sorted(r.event_id for r in stateful.pixel_pipeline(spark, DATA).select("event_id").collect())
    assert got == sorted(r.event_id for r in observations(spark, DATA).select("event_id").collect())


def test_hull_overlaps_equal_counted_points(spark):
    """Areas of hulls against points of a fine grid."""
    import numpy as np

    from glyphstream.functions import pixels

    rng = np.random.default_rng(4)
    v, u = np.mgrid[0:100:0.25, 0:100:0.25]
    grid = np.stack([u.ravel(), v.ravel()], 1) + 0.125

    def inside(p):
        h = pixels.hull(p)
        n = np.roll(h, -1, axis=0) - h
        return np.all([(dx * (grid[:, 1] - y) - dy * (grid[:, 0] - x)) >= 0 for (x, y), (dx, dy) in zip(h, n)], axis=0)

    for _ in range(12):
        a, b = rng.uniform(5, 95, (2, 5, 2))
        x, y = inside(a), inside(b)
        both = (x & y).sum()
        got = pixels.overlaps(a, b)
        want = both / max((x | y).sum(), 1), both / max(min(x.sum(), y.sum()), 1), both / max(x.sum(), 1), x.sum() / 16
        assert np.allclose(got[:3], want[:3], atol=0.02) and abs(got[3] - want[3]) <= 0.03 * want[3] + 3
    assert pixels.overlaps(a, a)[:3] == (1.0, 1.0, 1.0) and pixels.overlaps(a, a[:2])[:3] == (0.0, 0.0, 0.0)
    got = stateful.hull_overlaps(spark, DATA).collect()
    o = observations(spark, DATA)
    assert len(got) == o.count() - o.select("video_id").distinct().count() and all(0 <= r.iou <= r.over_smaller <= 1 and r.area > 0 for r in got)


def test_affine_motion_is_found():
    import numpy as np

    from glyphstream.functions import pixels

    rng = np.random.default_rng(2)
    scene = pixels.area_resize(rng.integers(0, 256, (60, 80)).astype(float), 80, 60)
    scene = np.rint(pixels.bilinear(np.kron(scene, np.ones((4, 4))), *np.mgrid[0:240, 0:320][::-1].astype(float).reshape(2, -1))).reshape(240, 320).astype(np.uint8)
    turn = 0.02
    m = np.array([[1.02 * np.cos(turn), -np.sin(turn), 3.0], [np.sin(turn), 1.02 * np.cos(turn), -2.0]])
    moved = pixels.warped(scene, m)
    got, share = pixels.affine(scene, moved)
    assert share >= 0.6 and np.abs(got[:, :2] - m[:, :2]).max() < 0.01
    inner = np.s_[30:-30, 30:-30]
    apart = lambda x: np.abs(x.astype(float) - moved)[inner].mean()
    dx, dy, _ = pixels.translation(scene, moved)
    assert apart(pixels.warped(scene, got)) < 0.5 * min(apart(scene), apart(pixels.shifted(scene, dx, dy)))
    assert np.allclose(pixels.affine(scene, pixels.shifted(scene, 5, -3))[0], [[1, 0, 5], [0, 1, -3]], atol=0.05)


def test_frames_are_spread_over_cores_and_stacks_equal_single_planes(spark):
    """One file of observations was one task; stacks give what each plane gives alone."""
    import numpy as np

    from glyphstream.functions import pixels

    assert stateful.pixel_pipeline(spark, DATA).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    rng = np.random.default_rng(6)
    before, now = rng.integers(0, 256, (2, 9, 60, 80)).astype(np.uint8)
    quads = np.array([[x, y, x + w, y + 1, x + w, y + 16, x, y + 15] for x, y, w in rng.integers(5, 30, (9, 3))], float).reshape(-1, 4, 2)
    now[4:], before[4:], quads[4:] = now[:5], before[:5], quads[:5]  # some are repeated
    got = stateful._features_of(before, now, quads)
    for f, b, a, q in zip(got, before, now, quads):
        crop, tiles, (dx, dy, _) = pixels.upright_crop(a, q), pixels.tile_scores(b, a), pixels.translation(b, a)
        assert f[0] == pixels.difference_bits(crop).hex() and f[-2:] == (dx, dy) and np.allclose(f[1:5], pixels.quality_parts(crop), atol=1e-6)
        assert abs(f[5] - tiles.mean()) <= 1e-6 and f[6] == (tiles >= 0.035).sum() and f[7] == len(pixels.change_scopes(tiles >= 0.035, 80, 60))
    delta, ys, xs = np.abs(now[0].astype(float) - before[0]) / 255, np.linspace(0, 60, 11).astype(int), np.linspace(0, 80, 17).astype(int)
    want = [[delta[a:b, c:e].mean() for c, e in zip(xs, xs[1:])] for a, b in zip(ys, ys[1:])]
    assert np.allclose(pixels.tile_scores(before[0], now[0]), want)
    assert pixels.change_scopes(np.eye(10, 16, dtype=bool), 80, 60) == [(0, 0, 60.0, 60.0)]
    corners = np.zeros((10, 16), bool)
    corners[0, 15] = corners[3, 0] = True
    assert pixels.change_scopes(corners, 80, 60) == [(65.0, 0, 80.0, 18.0), (0, 6.0, 15.0, 36.0)]


def test_overlaps_of_many_quads_equal_those_of_each(spark):
    """Also of quads that are not convex, have no area or run either way; the query's windows share one shuffle."""
    import numpy as np

    from glyphstream.functions import pixels

    rng = np.random.default_rng(9)
    turn = rng.uniform(0, 6.3, (2, 300))
    box = np.array([[-1, -1], [1, -1], [1, 1], [-1, 1]]) * rng.uniform(1, 40, (2, 300, 1, 2))
    x, y = box[..., 0], box[..., 1]
    quads = np.stack([x * np.cos(turn)[..., None] - y * np.sin(turn)[..., None], x * np.sin(turn)[..., None] + y * np.cos(turn)[..., None]], -1) + rng.uniform(0, 60, (2, 300, 1, 2))
    a, b = quads
    a[:60] = rng.uniform(0, 50, (60, 4, 2))  # any order of corners
    b[30:50] = b[30:50, ::-1]
    b[50:55] = b[50:55, :1]
    a[55:60] = a[55:60, [0, 1, 2, 1]]
    b[60:80], b[80:90] = a[60:80], a[80:90] + 500
    a[90:99] = np.rint(a[90:99])
    b[90:99] = a[90:99] + [3, 0]
    assert np.allclose(pixels.overlaps_each(a, b), [pixels.overlaps(p, q) for p, q in zip(a, b)], atol=1e-9, rtol=1e-12)
    assert pixels.overlaps_each(a[:0], b[:0]).shape == (0, 4)
    assert stateful.hull_overlaps(spark, DATA)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
