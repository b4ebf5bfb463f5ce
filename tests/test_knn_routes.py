"""What a cell's queries can reach is settled by the distances between pivots, and points are dealt to pivots once."""
import numpy as np

from vigil.operators import knn as K


def _summary(x, pivots):
    number, radius = K._Pivots(pivots, np.ones(len(pivots), np.int64)).nearest(x)
    at = [np.flatnonzero(number == i) for i in range(len(pivots))]
    return number, K._Cells(K._Pivots(pivots, np.ones(len(pivots), np.int64)), np.arange(len(pivots)) * K._PARTS, np.array([len(i) for i in at]),
                            np.array([radius[i].min() for i in at]), np.array([radius[i].max() for i in at]))


def test_queries_of_a_cell_measure_few_pivots(monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6000, 3)) * [1, 5, 20]
    number, cells = _summary(x, x[:300])
    measured = []
    squared = K._squared
    monkeypatch.setattr(K, "_squared", lambda a, b: measured.append(len(a) * len(b)) or squared(a, b))
    for own in range(0, 300, 9):
        rows = np.flatnonzero(number == own)
        q = x[rows]
        d = np.sqrt(((q[:, None] - x[None]) ** 2).sum(axis=2))
        bounds = np.sort(d, axis=1)[:, 9]                      # the tenth nearest
        sure = [set() for _ in rows]
        for row, cell in cells.within_reach(q, own, bounds):
            for r, c in zip(row.tolist(), cell.tolist()):
                sure[r].add(c)
        for i in range(len(rows)):
            assert set(number[d[i] <= bounds[i]].tolist()) <= sure[i]
        upper = cells.fallback(q, own, 10)
        assert (upper >= bounds).all() and np.isfinite(upper).all()
    queries = sum(int((number == own).sum()) for own in range(0, 300, 9))
    assert sum(measured) < 0.7 * queries * 300                 # every query was measured against all pivots twice, three times with its bound
    assert not np.isfinite(cells.fallback(x[:5], 0, 7000)).any()


def test_points_are_dealt_once(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=(700, 2)), rng.normal(size=(500, 2)) * 0.01])
    ids = [f"{i:04d}" for i in range(len(x))]
    base = K.distinct_points(spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "id string, vec array<double>"), 4)
    monkeypatch.setattr(K, "SIZED_ROWS", 300)
    dealt, deal = [], K._dealt
    monkeypatch.setattr(K, "_dealt", lambda points, pivots: dealt.append("ids" in points.columns) or deal(points, pivots))
    lists = {r.id: r.nbrs for r in K._search(None, base, 4, 20).collect()}
    assert sum(dealt) == 1 < len(dealt)
    for i in range(0, len(x), 7):
        key = K.rank_key(np.sqrt(((x - x[i]) ** 2).sum(axis=1)))
        assert lists[ids[i]] == [ids[j] for j in np.lexsort((ids, key))[:4]]


def test_lists_of_one_block_are_not_sorted_again(spark):
    """Most queries look into one block; theirs is taken as it is, and lists of several blocks are merged."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 2))
    base = K.distinct_points(spark.createDataFrame([(f"{i:04d}", v.tolist()) for i, v in enumerate(x)], "id string, vec array<double>"), 4)
    lists = K._search(None, base, 4, 50)
    plan = lists._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array" in plan and "(size(parts" in plan.replace("isnotnull", "")
    for r in lists.collect():
        key = K.rank_key(np.sqrt(((x - x[int(r.id)]) ** 2).sum(axis=1)))
        assert r.nbrs == [f"{j:04d}" for j in np.lexsort((np.arange(900), key))[:4]]
