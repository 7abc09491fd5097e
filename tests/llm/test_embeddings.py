import numpy as np

from oncekeep.llm import rp_forest

from .helpers import components


def check(spark, rows, threshold=0.95):
    frame = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1) for i, v in rows], "vec_id long, embedding array<float>, kept int")
    got = {r.vec_id: r for r in rp_forest.link_embeddings(frame, threshold).collect()}
    good = []
    for i, v in rows:
        x = None if v is None or any(c is None for c in v) else np.array(v, dtype=np.float32).astype(float)
        good.append(None if x is None or not len(x) or not np.isfinite(x).all() or not np.linalg.norm(x) else x / np.linalg.norm(x))
    links = [(a, b) for a in range(len(rows)) for b in range(a) if good[a] is not None and good[b] is not None and len(good[a]) == len(good[b]) and good[a] @ good[b] >= threshold]
    count = np.zeros(len(rows), int)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    order = sorted(range(len(rows)), key=lambda k: rows[k][0])
    place = {k: n for n, k in enumerate(order)}
    root = components(len(rows), [(place[a], place[b]) for a, b in links])
    return got, {rows[k][0]: (int(count[k]), rows[order[root[place[k]]]][0]) for k in range(len(rows))}


def test_awkward_vectors(spark):
    rows = [(5, None), (6, []), (7, [0, 0, 0]), (8, [1, None, 0]), (9, [float("nan"), 1, 0]), (10, [float("inf"), 1, 0]), (11, [1, 0, 0]), (4, [2, 0, 0]), (12, [1, 0, 0]), (13, [0, 1]), (14, [0, 2]), (15, [0, 1, 0]), (16, [1e-30, 0, 0])]
    got, expected = check(spark, rows)
    assert {i: (r.n_links, r.component_id) for i, r in got.items()} == expected
    assert all(r.kept == (r.component_id == i) for i, r in got.items())


def test_recall_on_clusters_and_a_dense_group(spark):
    r = np.random.default_rng(5)
    base = r.standard_normal((500, 32))
    near = [base[k % 60] + 0.18 * r.standard_normal(32) for k in range(600)]
    dense = [base[100] + 0.05 * r.standard_normal(32) for _ in range(500)]
    rows = list(enumerate([*base, *near, *dense, base[3], base[3]]))
    got, expected = check(spark, rows)
    links = sum(n for n, _ in expected.values())
    found = sum(r.n_links for r in got.values())
    assert all(got[i].n_links <= expected[i][0] for i in got) and found >= 0.98 * links
    assert sum(got[i].component_id == expected[i][1] for i in got) >= 0.99 * len(rows)


def test_empty_table(spark):
    assert rp_forest.link_embeddings(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_routed_rows_carry_packed_splits():
    import pyarrow as pa

    r = np.random.default_rng(3)
    units = r.standard_normal((3000, 16))
    units /= np.linalg.norm(units, axis=1)[:, None]
    splits = rp_forest._fit(1, "01", 16, 3000, units, rp_forest._margin(0.95, 16))
    packed = rp_forest._pack_splits("01", splits)
    assert len(splits) > 5 and len(packed) == 13 * len(splits) and rp_forest._pack_splits("", []) == b""
    assert rp_forest._unpack_splits("01", packed) == {at: (turn, cut) for at, turn, cut in splits}
    n = len(units)
    columns = [pa.array(range(n), pa.int64()), pa.array([1] * n, pa.int64()), pa.array([16] * n, pa.int32()), pa.array([1] * n, pa.int32())]
    columns += [pa.array([u.astype("<f8").tobytes() for u in units], pa.binary()), pa.array(["01"] * n), pa.array([packed] * n, pa.binary())]
    rows = pa.RecordBatch.from_arrays(columns, names=["node", "n", "size", "tree", "unit", "path", "splits"])
    moved = rp_forest._routed(rows, 16, 1, "01", 0.95)
    got = {}
    for node, path in zip(moved.column("node").to_pylist(), moved.column("path").to_pylist(), strict=True):
        got.setdefault(path, set()).add(node)
    want, cuts = {"01": set(range(n))}, {at: (turn, cut) for at, turn, cut in splits}
    while any(at in cuts for at in want):
        at = next(at for at in want if at in cuts)
        own, (turn, cut) = np.array(sorted(want.pop(at))), cuts[at]
        x = units[own] @ rp_forest._direction(1, at, turn, 16)
        want |= {at + "0": set(own[x <= cut + rp_forest._margin(0.95, 16)]), at + "1": set(own[x >= cut - rp_forest._margin(0.95, 16)])}
    assert got == want and not any(moved.column("done").to_pylist())
    assert rp_forest._routed(rows.set_column(6, "splits", pa.array([b""] * n, pa.binary())), 16, 1, "01", 0.95).column("done").to_pylist() == [True] * n


def test_places_are_stored_without_vectors(spark, monkeypatch):
    """Tables of the split rounds hold a few bytes per place, and none of them stays behind."""
    r = np.random.default_rng(9)
    made, gone, store, drop = [], set(), rp_forest.written, rp_forest.discard

    def watched(df, label):
        out = store(df, label)
        made.append((label, out))
        return out

    def dropped(df):
        gone.add(id(df))
        drop(df)

    monkeypatch.setattr(rp_forest, "written", watched)
    monkeypatch.setattr(rp_forest, "discard", dropped)
    rows = [(i, v) for i, v in enumerate(r.standard_normal((1500, 16)))]
    check(spark, rows)
    places = [df for label, df in made if label == "rp-rows"]
    assert len(places) >= 2 and all(sorted(df.columns) == ["done", "node", "path", "size", "tree"] for df in places)
    assert {id(df) for label, df in made if label != "rp-groups"} <= gone


def test_floats_and_doubles_link_alike(spark):
    r = np.random.default_rng(11)
    base = r.standard_normal((40, 24)).astype(np.float32)
    vectors = np.concatenate([base, base + 0.2 * r.standard_normal((40, 24)).astype(np.float32), 1e-30 * base[:5], 1e30 * base[:5]])
    rows = [(i, [float(x) for x in v.astype(np.float32)]) for i, v in enumerate(vectors)]
    got = [
        {x.vec_id: tuple(x) for x in rp_forest.link_embeddings(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")).collect()}
        for kind in ("float", "double")
    ]
    assert got[0] == got[1] and sum(x[1] for x in got[0].values()) >= 30


def test_nothing_that_grows_with_the_vectors_is_broadcast(spark, monkeypatch):
    """Joins on a vector, a component or the vector itself are planned as shuffles however small the files look."""
    keep, plans = rp_forest.written, []

    def planned(df):
        return [line for line in df._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join" in line]

    def spied(df, label):
        plans.extend(planned(df))
        return keep(df, label)

    monkeypatch.setattr(rp_forest, "written", spied)
    rows = [(i, [float(i % 7 + 1), float(i % 5), 1.0]) for i in range(40)]
    out = rp_forest.link_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 0.95)
    plans.extend(planned(out))
    ours = [line for line in plans if any(f"Join [{key}#" in line for key in ("node", "root", "_v"))]
    assert len(ours) >= 6 and not [line for line in ours if "BroadcastHashJoin" in line]
