"""Mixtures and networks: agreement with numpy, recovery, determinism, targets."""

from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from insolara.operators import mixture as M
from insolara.operators import network as N
from insolara.operators import stats as L
from insolara.operators import tsqr as Q
from insolara.operators.partials import summed
from insolara.operators.stacks import Stack
from tests.conftest import rows


def vectors(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "i int, v array<double>")


@pytest.fixture(scope="module")
def two_clusters():
    rng = np.random.default_rng(11)
    return np.concatenate([rng.normal(0.0, 1.0, (120, 10)), rng.normal(6.0, 1.5, (80, 10))])


def numpy_em(x, weights, means, spread, rounds, kind):
    n, d = x.shape
    for _ in range(rounds):
        logs = np.empty((n, len(weights)))
        for j in range(len(weights)):
            cov = spread[j] if kind == "full" else np.diag(spread[j])
            gap = x - means[j]
            logs[:, j] = (np.log(weights[j]) - 0.5 * (d * np.log(2 * np.pi) + np.linalg.slogdet(cov)[1]
                                                     + np.einsum("ij,jk,ik->i", gap, np.linalg.inv(cov), gap)))
        resp = np.exp(logs - np.logaddexp.reduce(logs, axis=1)[:, None])
        mass = resp.sum(0)
        weights, means = mass / n, resp.T @ x / mass[:, None]
        fresh = []
        for j in range(len(weights)):
            gap = x - means[j]
            cov = (resp[:, j, None] * gap).T @ gap / mass[j] + 1e-6 * np.eye(d)
            own = np.diag(cov)
            fresh.append(cov if kind == "full" else own if kind == "diag" else np.full(d, own.mean()))
        spread = np.array(fresh)
    return weights, means, spread


@pytest.mark.parametrize("kind", M.KINDS)
def test_em_equals_numpy(spark, two_clusters, kind):
    x = two_clusters[:, :3] + 1000.0
    d, k = 3, 2
    var = np.full((k, d), 4.0) if kind != "full" else np.repeat(4.0 * np.eye(d)[None], k, axis=0)
    start = M.Mixture(kind, np.array([0.3, 0.7]), np.array([[1001.0] * d, [1004.0] * d]), var)
    got = M.gmm_fit(vectors(spark, x).repartition(5), "v", d, k, 4, kind, start, gain=-np.inf)
    weights, means, spread = numpy_em(x, start.weights, start.means, start.variances, 4, kind)
    assert got.weights == pytest.approx(weights) and got.means == pytest.approx(means)
    assert got.variances == pytest.approx(spread, rel=1e-6)
    assert all(b >= a - 1e-9 for a, b in zip(got.history, got.history[1:]))


@pytest.mark.parametrize("start", ["kmeans", "bands"])
@pytest.mark.parametrize("kind", M.KINDS)
def test_clusters_are_recovered(spark, two_clusters, kind, start):
    df = vectors(spark, two_clusters)
    model = M.gmm_fit(df, "v", 10, 2, 50, kind, start)
    labels = np.array([r[1] for r in rows(M.gmm_predict(df, "v", model).select("i", "cluster"), "i")])
    assert (labels == np.repeat([0, 1], [120, 80])).all()
    assert rows(M.cluster_counts(M.gmm_predict(df, "v", model)), "cluster") == [(0, 120), (1, 80)]


def test_incomplete_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, None), (5, [5.0, 5.0])],
                               "i int, v array<double>")
    model = M.gmm_fit(df, "v", 2, 1, 3, "diag", "bands")
    assert model.means[0] == pytest.approx([3.0, 3.5])
    wide = M.Mixture("full", np.array([1.0]), model.means, np.eye(2)[None])
    for m in (model, wide):
        assert [r[1] for r in rows(M.gmm_predict(df, "v", m).select("i", "cluster"), "i")] == [0, None, None, None, 0]


def test_bic_prefers_two(spark, two_clusters):
    table = M.gmm_bic(vectors(spark, two_clusters), "v", 10, (1, 2, 3), "diag", 50).orderBy("bic").collect()
    assert table[0]["k"] == 2
    assert {r["k"]: r["params"] for r in table} == {1: 20, 2: 41, 3: 62}
    n, one = len(two_clusters), next(r for r in table if r["k"] == 1)
    x = two_clusters
    loglik = -0.5 * (np.log(2 * np.pi * (x.var(0) + 1e-6)) + (x - x.mean(0)) ** 2 / (x.var(0) + 1e-6)).sum()
    assert one["bic"] == pytest.approx(-2 * loglik + 20 * np.log(n), rel=1e-9)


def test_sums_over_partitions(spark):
    def task(batches):
        total = np.zeros(2)
        for b in batches:
            total += [b.num_rows, sum(b.column("id").to_pylist())]
        yield 3, total

    for parts in (1, 13):
        assert summed(spark.range(0, 100, 1, parts), task)[3].tolist() == [100.0, 4950.0]


@pytest.mark.parametrize("activation", sorted(N.ACTIVATIONS))
def test_gradient_equals_differences(activation):
    rng = np.random.default_rng(3)
    net = N.Network.create(3, (4, 3), activation, 5)
    x, y = rng.normal(size=(20, 3)), rng.normal(size=20)
    flat = net.flat()
    _, grad = net.gradient(x, y)
    for i in range(len(flat)):
        step = np.zeros_like(flat)
        step[i] = 1e-6
        up, down = (0.5 * N.Network.from_flat(net.sizes, activation, flat + s).gradient(x, y)[0] for s in (step, -step))
        assert grad[i] == pytest.approx((up - down) / 2e-6, rel=1e-4, abs=1e-6)


@pytest.fixture(scope="module")
def smooth(spark):
    rng = np.random.default_rng(9)
    x = rng.uniform(-1, 1, (2000, 3))
    y = 100 + 30 * np.sin(2 * x[:, 0]) + 20 * x[:, 1] * x[:, 2]
    data = [(*map(float, r), float(t), i % 12) for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(data, "a double, b double, c double, y double, m int")
    return df.withColumn("dt", F.lit("2004-01-15").cast("timestamp_ntz") + F.make_ym_interval(months=F.col("m"))).cache()


X = ["a", "b", "c"]


@pytest.mark.parametrize("batch_size", [None, 50])
def test_training_does_not_depend_on_partitions(spark, smooth, batch_size):
    plan = N.Training(learning_rate=0.05, batch_size=batch_size, max_iter=5)
    results = []
    for parts, rows_in_batch in ((4, 10_000), (8, 100), (13, 37)):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows_in_batch))
        dealt = smooth.repartition(parts)
        results.append(N.train_networks(dealt, X, "y", [N.Network.create(3, (5,), "tanh", 1)], [plan])[0])
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    for other in results[1:]:
        assert results[0].network.flat() == pytest.approx(other.network.flat(), rel=1e-9)
    assert results[0].losses[-1] < results[0].losses[0] and results[0].epochs == 5


def test_blocks_do_not_depend_on_batches(monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 4)
    shards, values = [0] * 5 + [2] * 4 + [3] * 9, list(range(18))

    def batch(a, b):
        return pa.RecordBatch.from_pydict({"shard": shards[a:b], "x": [[float(v)] for v in values[a:b]], "y": [float(v) for v in values[a:b]]})

    for cuts in ([0, 18], [0, 1, 2, 3, 9, 10, 18], [0, 4, 5, 13, 18]):
        got = [(s, n, y.tolist()) for s, n, _, y in N._blocks((batch(a, b) for a, b in zip(cuts, cuts[1:])), 1)]
        assert got == [(0, 0, [0, 1, 2, 3]), (0, 1, [4]), (2, 0, [5, 6, 7, 8]), (3, 0, [9, 10, 11, 12]), (3, 1, [13, 14, 15, 16]), (3, 2, [17])]


def test_a_loss_that_is_not_finite_is_an_error(smooth):
    plan = N.Training(solver="sgd", learning_rate=1e6, batch_size=None, max_iter=50)
    with pytest.raises(FloatingPointError):
        N.train_networks(smooth, X, "y", [N.Network.create(3, (5,), "identity", 1)], [plan])


def test_training_reaches_the_target(smooth):
    made = N.mlp_train(smooth, X, "y", 2, 10, max_iter=40, plan=N.Training(learning_rate=0.05, batch_size=50))
    assert made.r2 >= 0.8
    predicted = N.mlp_predict(smooth, made.network, X, made.scaler).select(*X, "prediction").collect()
    plain = (np.array([[r[c] for c in X] for r in predicted]) - made.scaler.means) / made.scaler.scales
    assert [r["prediction"] for r in predicted] == pytest.approx(made.network.predict(plain).tolist())


def test_stacked_networks_equal_single_ones(smooth):
    """Unlike widths, depths, activations, solvers and seeds in one loop, against one by one."""
    plan = N.Training(learning_rate=0.02, batch_size=64, max_iter=6, tol=1e-3, patience=2)
    plans = [plan, replace(plan, seed=3), replace(plan, solver="sgd", schedule="invscaling"), replace(plan, solver="sgd", momentum=0.0),
             replace(plan, learning_rate=0.2, max_iter=40), replace(plan, alpha=0.1), replace(plan, batch_size=50)]
    shapes = [((2, 5), "tanh"), ((6, 3), "tanh"), ((4,), "logistic"), ((7,), "logistic"), ((3, 3), "tanh"), ((9, 2), "tanh"), ((2, 2), "relu")]
    nets = [N.Network.create(3, hidden, act, i) for i, (hidden, act) in enumerate(shapes)]
    together = N.train_networks(smooth, X, "y", nets, plans)
    for net, how, fit in zip(nets, plans, together):
        alone = N.train_networks(smooth, X, "y", [net], [how])[0]
        assert fit.network.flat() == pytest.approx(alone.network.flat(), rel=1e-9)
        assert fit.losses == pytest.approx(alone.losses, rel=1e-9) and fit.score == pytest.approx(alone.score, rel=1e-9)
    assert 6 < together[4].epochs <= 40


def test_steps_of_a_stack_equal_a_plain_loop():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(30, 3)), rng.normal(size=30)
    nets = [N.Network.create(3, h, "logistic", i) for i, h in enumerate([(4, 2), (2, 5)])]
    how = N.Training(learning_rate=0.1)
    zeros = [np.zeros_like(n.flat()) for n in nets]
    stack = Stack([n.sizes for n in nets], "logistic", "adam", [n.flat() for n in nets], zeros, zeros)
    states = [N._State.fresh(n.flat()) for n in nets]
    for step in range(1, 5):
        sse, grads = stack.gradient(x, y)
        stack.step(grads, 30, np.full((2, 1, 1), 0.1), np.full((2, 1, 1), how.alpha), np.zeros((2, 1, 1)), np.full((2, 1, 1), float(step)))
        for i, (net, state) in enumerate(zip(nets, states)):
            now = N.Network.from_flat(net.sizes, "logistic", state.w)
            miss, grad = now.gradient(x, y)
            assert sse[i] == pytest.approx(miss)
            state.step((grad + how.alpha * now.mask() * state.w) / 30, how)
            assert stack.flats(stack.values)[i] == pytest.approx(state.w)


@pytest.mark.parametrize("shards", [1, 3])
def test_rounds_and_shards(spark, smooth, shards):
    """The length of a round does not matter for one shard; several shards give one result for any partitions."""
    plan = N.Training(learning_rate=0.02, batch_size=50, max_iter=7, tol=0.5, patience=3)
    rows = N.training_rows(smooth, X, "y").select(F.lit(0).alias("key"), "x", "y")
    start = N.Network.create(3, (4,), "tanh", 1)
    fits = [N.train_keyed(rows.repartition(parts), 3, [(0, start, plan)] * 2, shards=shards, sync=sync)[0][-1]
            for parts, sync in ((2, 1), (7, 1), (3, 4), (3, None))]
    assert fits[0].network.flat() == pytest.approx(fits[1].network.flat(), rel=1e-9)
    if shards == 1:
        for fit in fits[2:]:
            assert fit.network.flat() == pytest.approx(fits[0].network.flat(), rel=1e-9) and fit.losses == pytest.approx(fits[0].losses)
    assert all(f.losses[-1] < f.losses[0] for f in fits)


def test_seasonal_models_equal_separate_runs(smooth):
    """One loop for all blocks, with retries, against each block alone; a block that no start can bring to the target ends."""
    plan = N.Training(learning_rate=0.02, batch_size=25)
    made = N.mlp_train_seasonal(smooth, X, "y", 2, 6, max_iter=4, target=0.97, attempts=3, plan=plan)
    for block, months in N.TRAINING_BLOCKS.items():
        rows_ = smooth.where(F.month("dt").isin(*months))
        best = None
        for attempt in range(3):
            tried = N.mlp_train(rows_, X, "y", 2, 6, 4, replace(plan, seed=attempt))
            best = tried if best is None or tried.r2 > best.r2 else best
            if tried.r2 >= 0.97:
                break
        assert made[block].network.flat() == pytest.approx(best.network.flat(), rel=1e-7)
        assert made[block].r2 == pytest.approx(best.r2) and made[block].scaler.means == pytest.approx(best.scaler.means)
    assert N.mlp_train_seasonal(smooth.limit(0), X, "y", 1, 2) == {}


def test_seasonal_models_reach_the_target(smooth):
    made = N.mlp_train_seasonal(smooth, X, "y", 2, 10, max_iter=40, attempts=3, plan=N.Training(learning_rate=0.05, batch_size=25))
    assert sorted(made) == ["020304", "050607", "080910", "111201"]
    assert all(t.r2 >= 0.8 for t in made.values())


def test_prediction_of_incomplete_rows_is_null(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, None, 2.0), (3, float("inf"), 2.0)], "i int, a double, b double")
    for hidden in ((3,), (20, 20)):
        net = N.Network.create(2, hidden, "logistic", 0)
        got = rows(N.mlp_predict(df, net, ["a", "b"]).select("i", "prediction"), "i")
        assert got[1][1] is None and got[2][1] is None
        assert got[0][1] == pytest.approx(float(net.predict(np.array([[1.0, 2.0]]))[0]))


@pytest.mark.parametrize("kind", M.KINDS)
def test_labels_of_vectors_that_do_not_fit_are_null(spark, kind):
    spread = np.ones((2, 2)) if kind != "full" else np.repeat(np.eye(2)[None], 2, axis=0)
    model = M.Mixture(kind, np.array([0.5, 0.5]), np.array([[0.0, 0.0], [5.0, 5.0]]), spread)
    data = [(0, [0.1, 0.0]), (1, [5.0, 4.0]), (2, [float("inf"), 1.0]), (3, [1.0]), (4, [1.0, 2.0, 3.0]), (5, None), (6, [1.0, None])]
    got = M.gmm_predict(spark.createDataFrame(data, "i int, v array<double>"), "v", model).orderBy("i").collect()
    assert [r["cluster"] for r in got] == [0, 1, None, None, None, None, None]


def test_sweeps_have_one_row_per_epoch(smooth):
    acts = N.mlp_sweep_activation(smooth, X, "y", max_iter=3)
    assert acts.count() == 12 and acts.select("label").distinct().count() == 4
    layers = N.mlp_sweep_layers(smooth, X, "y", max_iter=2)
    assert layers.count() == 6
    solvers = N.mlp_sweep_solver(smooth, X, "y", max_iter=2, scale=True)
    assert solvers.count() == 10 and solvers.where("epochs = 2").count() == 10


def test_bic_grid(smooth):
    table = {(r["n1"], r["n2"]): r for r in N.mlp_bic_grid(smooth, X, "y", (2, 5), max_iter=2).collect()}
    assert table[(2, 5)]["p"] == 3 + 2 * 7 + 2
    assert min(r["delta"] for r in table.values()) == 0
    assert N.true_parameter_count(3, (2, 5)) == 8 + 15 + 6


def test_best_of_takes_the_least_error(smooth):
    net, report = N.mlp_best_of(smooth.where("m < 9"), smooth.where("m >= 9"), X, "y", 3, max_iter=3)
    table = report.orderBy("nmae").collect()
    assert table[0]["best"] and sum(r["best"] for r in table) == 1
    assert net.sizes == [3, 6, 4, 1]


def test_candidates_are_drawn_by_distance(spark, two_clusters):
    """Far rows become candidates, partitions do not matter, and every row is counted at its nearest candidate."""
    x = np.concatenate([two_clusters, np.full((3, 10), 50.0)])
    df = vectors(spark, x).select(F.col("v").alias("x"))
    points, weights = M.candidate_centers(df.repartition(3), 10, 4, 7)
    again, same = M.candidate_centers(df.repartition(7), 10, 4, 7)
    assert np.array_equal(points, again) and np.array_equal(weights, same)
    assert weights.sum() == len(x) and (np.abs(points - 50).max(axis=1) == 0).sum() == 1
    assert weights[np.abs(points - 50).max(axis=1) == 0] == 3
    assert all((np.abs(x - p).max(axis=1) == 0).any() for p in points)


def test_starts_of_all_counts_equal_single_starts(spark, two_clusters):
    rows_ = M.vectors(vectors(spark, two_clusters), "v", 10).select("x")
    shift = M.center(rows_, 10)
    together = M.start_kmeans(rows_, 10, [1, 2, 5], "diag", shift, 3)
    near = {0: two_clusters[:120], 1: two_clusters[120:]}
    order = np.argsort(together[1].means[:, 0])
    for cluster, j in enumerate(order):
        assert together[1].means[j] == pytest.approx(near[cluster].mean(0)) and together[1].weights[j] == pytest.approx(len(near[cluster]) / 200)
    assert together[0].means[0] == pytest.approx(two_clusters.mean(0))
    assert together[2].weights.sum() == pytest.approx(1.0) and together[2].k == 5
    few = M.start_kmeans(M.vectors(vectors(spark, two_clusters[:3]), "v", 10).select("x"), 10, [5], "diag", shift, 3)
    assert few[0].k == 5  # fewer rows than clusters: the others borrow the overall spread


def test_regression_on_nearly_dependent_columns(spark):
    """Columns that differ in the ninth digit: sums of squares lose them, QR factors do not."""
    rng = np.random.default_rng(1)
    a = rng.normal(size=3000) + 100
    b = a + 1e-7 * rng.normal(size=3000)
    c = rng.normal(size=3000)
    y = 3 + 2 * a - 5 * b + 0.5 * c
    df = spark.createDataFrame([tuple(map(float, r)) for r in np.stack([a, b, c, y], axis=1)] + [(1.0, None, 2.0, 3.0), (float("nan"), 1.0, 1.0, 1.0)],
                               "a double, b double, c double, y double").repartition(6)
    got = dict(rows(Q.least_squares(df, ["a", "b", "c"], "y")))
    assert [got[t] for t in ("intercept", "a", "b", "c")] == pytest.approx([3, 2, -5, 0.5], rel=1e-4)
    both = dict(rows(Q.least_squares(df.withColumn("d", F.col("c") * 2), ["c", "d"], "c")))  # dependent: the shortest solution
    assert both["c"] + 2 * both["d"] == pytest.approx(1.0)
    with pytest.raises(ValueError):
        Q.least_squares(df.limit(0), ["a"], "y")


@pytest.mark.parametrize("fan", [512, 2])
def test_components_by_qr(spark, monkeypatch, fan):
    monkeypatch.setattr("insolara.operators.partials.FAN", fan)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 4)) @ rng.normal(size=(4, 4)) + 50
    std = (x - x.mean(0)) / x.std(0)
    values, axes = np.linalg.eigh(np.cov(std.T))
    data = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    bad = [(900, [1.0, 2.0, None, 3.0]), (901, [float("nan"), 1.0, 1.0, 1.0]), (902, None), (903, [1.0])]
    df = spark.createDataFrame(data + bad, "i int, v array<double>").repartition(7)
    got = Q.vector_components(df, "v", 4).orderBy("component").collect()
    assert [r["variance"] for r in got] == pytest.approx(values[::-1].tolist())
    for r, axis in zip(got, axes.T[::-1]):
        assert abs(np.dot(r["loadings"], axis)) == pytest.approx(1.0)
    columns = df.where(F.size("v") == 4).select(*[F.col("v")[k].alias(f"c{k}") for k in range(4)])
    assert [r["variance"] for r in Q.components(columns, ["c0", "c1", "c2", "c3"]).orderBy("component").collect()] == pytest.approx(values[::-1].tolist())
    assert [r["variance"] for r in L.pca_variance_vector(df, "v", 4).orderBy("component").collect()] == pytest.approx(values[::-1].tolist())
