import numpy as np
import pytest
from pyspark.sql import functions as F

from verdigris.functions import quantizer as Q
from verdigris.operators import vectors as V
from verdigris.sources import index_file


def unit(n, dim, seed=3):
    v = np.random.default_rng(seed).normal(size=(n, dim))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def frame(spark, v):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<float>")


def queries(df, n):
    return df.filter(F.col("vec_id") < n).select(F.col("vec_id").alias("query_id"), "embedding")


def test_rotation_is_the_published_one():
    r = Q.rotation(64)
    assert np.allclose(r[0, :4], [-0.20426874, 0.00341516, -0.22104374, 0.06849034], atol=1e-7)
    assert abs(r[63, 63] - 0.2737887) < 1e-7
    assert np.abs(r.astype(float) @ r.T.astype(float) - np.eye(64)).max() < 1e-6


@pytest.mark.parametrize("bits, want", [(2, [0.05651487, 0.18749686]), (3, [0.03046918, 0.09383226, 0.16616786, 0.26391393]), (4, [0.01591898, 0.04808967])])
def test_codebook(bits, want):
    bounds, c = Q.codebook(bits, 64)
    assert np.allclose(c[len(c) // 2 :][: len(want)], want, atol=1e-6)
    assert np.allclose(bounds, (c[1:] + c[:-1]) / 2, atol=1e-7) and np.allclose(c, -c[::-1])


@pytest.mark.parametrize("bits", [2, 3, 4])
def test_packing_and_file_round_trip(bits):
    codes = np.random.default_rng(bits).integers(0, 1 << bits, (33, 64)).astype(np.int8)
    assert (Q.unpack_planes(Q.pack_planes(codes.astype(np.uint8), bits), bits, 64) == codes).all()
    scales, ids = np.linspace(0, 1, 33, dtype=np.float32), np.arange(33)[::-1] * 7
    for i in (None, ids):
        c, s, b, back = index_file.loads(index_file.dumps(codes, scales, bits, i))
        assert (c == codes).all() and (s == scales).all() and b == bits and (back is None if i is None else (back == i).all())


def test_bad_files():
    good = index_file.dumps(np.zeros((2, 8), np.int8), np.zeros(2), 2, np.array([1, 2]))
    for raw in (b"\x04rest", b"garbage!", good[:4] + b"\x09" + good[5:], good[:-3]):
        with pytest.raises(ValueError):
            index_file.loads(raw)
    with pytest.raises(ValueError):
        index_file.dumps(np.zeros((2, 8), np.int8), np.zeros(2), 2, np.array([1, 1]))


def test_quality(spark):
    v = unit(300, 64)
    df = frame(spark, v)
    own = V.top_k_quantized(V.encode(df, 4), queries(df, 50), 4, 1).collect()
    assert sum(r.query_id == r.vec_id for r in own) >= 49
    for bits, bound in ((2, 0.1175), (3, 0.03454), (4, 0.009497)):
        d = V.distortion(frame(spark, unit(400, 256)), bits).first()
        assert abs(d.mse_x_dim - bound) < 0.08 * bound and abs(d.self_score - 1) < 0.01


def test_mask_is_post_filter(spark):
    df = frame(spark, unit(129, 16))
    q = queries(df, 5)
    masked = V.top_k(df.filter("vec_id % 2 = 0"), q, 7)
    every = V._ranked(V.top_k(df, q, 129).filter("vec_id % 2 = 0").select("query_id", "vec_id", "score"), 7)
    assert masked.exceptAll(every).isEmpty() and masked.count() == 35
    assert V.top_k(df, q, 500).count() == 5 * 129  # k shrinks to what there is
    assert V.top_k(df, q, 0).isEmpty()
    with pytest.raises(ValueError):
        V.top_k(df, q, -1)


def test_lut_agrees(spark):
    df = frame(spark, unit(200, 64))
    q, codes = queries(df, 10), V.encode(df, 4)
    a = {(r.query_id, r.vec_id): r.score for r in V.top_k_quantized(codes, q, 4, 200).collect()}
    b = {(r.query_id, r.vec_id): r.score for r in V.top_k_quantized(codes, q, 4, 200, lut=True).collect()}
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 0.03


def test_edges(spark):
    df = frame(spark, np.zeros((2, 16)))
    assert [r.scale for r in V.encode(df).collect()] == [0.0, 0.0]
    assert V.top_k(df.limit(0), queries(df, 1), 3).isEmpty()
    with pytest.raises(ValueError):
        V.check_allow_list(df, df.limit(0).select("vec_id"))
    with pytest.raises(ValueError):
        V.check_allow_list(df, spark.createDataFrame([(99,)], "vec_id long"))
    assert sorted(r.vec_id for r in V.remove(df, spark.createDataFrame([(1,)], "vec_id long")).collect()) == [0]


def test_blocks_of_queries(spark, monkeypatch):
    df = frame(spark, unit(60, 16))
    whole = V.top_k(df, queries(df, 20), 3).collect()
    monkeypatch.setattr(V, "BLOCK_BYTES", 600)
    assert sorted(V.top_k(df, queries(df, 20), 3).collect()) == sorted(whole)


def test_ragged_vectors_are_refused(spark):
    rows = [(0, [1.0, 2.0, 3.0]), (1, [1.0, 2.0, 3.0, 4.0, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    for own in (df, spark.createDataFrame([(0, [1.0, None])], "vec_id long, embedding array<float>")):
        with pytest.raises(Exception, match="different dimensions|null element"):
            V.top_k(own, queries(own, 1), 1).collect()


def test_a_task_keeps_its_best():
    """The running k best of slices equal those of all rows sorted at once, ties by id."""
    rng = np.random.default_rng(5)
    ids, scores = rng.permutation(500), rng.integers(0, 40, (500, 6)).astype(float)
    for k in (1, 7, 100, 600):
        best = V._Best(6, k)
        for a in range(0, 500, 90):
            best.add(ids[a : a + 90], scores[a : a + 90])
        for q in range(6):
            assert best.ids[:, q].tolist() == ids[np.lexsort((ids, -scores[:, q]))][:k].tolist()


def test_best_of_odd_scores():
    """Scores that are no numbers come first, as in an ORDER BY; scores equal after rounding go by id, whatever the order of rows."""
    rng = np.random.default_rng(6)
    scores = rng.normal(size=(700, 5))
    scores[rng.random(scores.shape) < 0.02] = np.nan
    scores[rng.random(scores.shape) < 0.02] = -np.inf
    scores[100:600, 1] = 3 + rng.normal(size=500) * 1e-7
    ids = rng.permutation(700)
    for k in (1, 20, 300, 690):
        best = V._Best(5, k)
        for a in range(0, 700, 90):
            best.add(ids[a : a + 90], scores[a : a + 90])
        for q in range(5):
            order = sorted(range(700), key=lambda i: (not np.isnan(s := scores[i, q]), 0 if np.isnan(s) else -round(s, 6) if np.isfinite(s) else -s, ids[i]))
            assert best.ids[:, q].tolist() == ids[order[:k]].tolist()


def test_memory_of_a_task_is_bounded(spark, monkeypatch):
    """A task's arrays don't grow with rows x queries; tiles give what all scores at once would."""
    import tracemalloc

    import pyarrow as pa

    v = unit(20_000, 8).astype(np.float32)
    df = frame(spark, v[:2])
    taken = []
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema: taken.append(f) or spark.createDataFrame([], schema))
    monkeypatch.setattr(V, "_blocks", lambda *_: [(np.arange(len(v)), v.astype(np.float64))])
    codes, scale = Q.encode(v, 4)
    lists = lambda a: pa.ListArray.from_arrays(np.arange(0, a.size + 1, 8, dtype=np.int32), pa.array(a.reshape(-1)))
    rows = pa.RecordBatch.from_arrays([pa.array(np.arange(len(v))), lists(v), lists(codes), pa.array(scale)], ["vec_id", "embedding", "codes", "scale"])
    batches = [rows.slice(a, 2048) for a in range(0, 6144, 2048)]
    near = Q.codebook(4, 8)[1].astype(np.float64)[codes[:6144]] * scale[:6144, None]
    searches = [
        (lambda: V.top_k(df, df, 3), lambda q: v[:6144].astype(np.float64) @ v[q].astype(np.float64)),
        (lambda: V.top_k_quantized(df.withColumns({"codes": F.lit(None), "scale": F.lit(None)}), df, 4, 3), lambda q: near @ (Q.rotation(8).astype(np.float64) @ v[q].astype(np.float64))),
        (lambda: V.top_k_quantized(df.withColumns({"codes": F.lit(None), "scale": F.lit(None)}), df, 4, 3, lut=True), None),
    ]
    for search, brute in searches:
        taken.clear()
        search()
        tracemalloc.start()
        out = pa.Table.from_batches(list(taken[0](iter(batches))))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 80e6, peak
        assert out.num_rows == 3 * len(v)
        for q in (0, 777, 19_999) if brute else ():
            scores = np.round(brute(q), 6) + 0.0
            want = np.lexsort((np.arange(6144), -scores))[:3].tolist()
            assert out.filter(pa.compute.equal(out["query_id"], q))["vec_id"].to_pylist() == want


def test_recall_targets(spark):
    """Recall among 10 of the codes' scores, as measured on the published algorithm."""
    from verdigris.plans.vectors import QUERIES

    for bits, least in ((2, 0.62), (3, 0.78), (4, 0.88)):
        found = QUERIES[f"vec_recall_{bits}bit"](spark, "/root/testdata/sf0.1")
        assert found.agg(F.avg("recall")).first()[0] >= least
