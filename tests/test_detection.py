import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from packetloom.functions import scalars as SC
from packetloom.operators import anomaly as A, detect as D, evaluate as E, quantiles as Q
from packetloom.operators.ordered_fold import fold_sliced
from packetloom.operators.threshold import HostScores, _fold, _propagate, adaptive_threshold
from packetloom.params import Params


def run(scores, veto=None, p=Params()):
    host, out = HostScores(p), []
    for i, s in enumerate(scores):
        limit = host.threshold()
        alert = s >= limit and not (veto is not None and veto[i])
        if not alert:
            host.learn(s)
        out.append((limit, alert))
    return host, out


def test_calm_host_keeps_the_floor():
    host, _ = run(np.random.default_rng(0).uniform(0, .6, 300))
    assert host.threshold() == 0.98


def test_odd_host_raises_its_bar_within_the_ceiling():
    host = HostScores(Params())
    for s in np.random.default_rng(1).beta(7, 1.1, 400):
        host.learn(float(s))
    assert 0.98 < host.threshold() <= 0.995


def test_a_patient_attacker_moves_nothing():
    quiet = list(np.random.default_rng(2).uniform(0, .6, 200))
    before = run(quiet)[0].threshold()
    after = run(quiet + [0.999] * 5000)[0].threshold()
    assert before == after


def test_ceiling():
    host = HostScores(Params())
    for _ in range(300):
        host.learn(0.99999)
    assert 0.97 <= host.threshold() <= 0.995


def test_cold_start_reads_before_learning():
    _, out = run([0.5] * 59 + [0.985])
    assert out[-1] == (0.98, True)


def scored(spark, n=4000, hosts=3, seed=3):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({
        "capture_id": "c", "src": np.where(rng.random(n) < .7, "hot", rng.integers(0, hosts, n).astype(str)),
        "end_us": np.arange(n), "seq": np.arange(n),
        "score": np.where(rng.random(n) < .3, rng.uniform(.97, 1, n), rng.random(n)),
        "veto": rng.random(n) < .1})
    return spark.createDataFrame(pdf), pdf


def test_one_busy_host_in_pieces_equals_the_sequential_fold(spark):
    df, pdf = scored(spark)
    p = Params(group_rows=100)
    out = adaptive_threshold(df, ["end_us", "seq"], p, pieces=7).toPandas().sort_values("seq")
    want = []
    for _, g in pdf.groupby("src"):
        _, res = run(g["score"].to_numpy(), g["veto"].to_numpy())
        want += list(zip(g["seq"], res))
    want = [r for _, r in sorted(want)]
    assert list(out["threshold"]) == [w[0] for w in want]
    assert list(out["is_alert"]) == [w[1] for w in want]
    whole = adaptive_threshold(df, ["end_us", "seq"]).toPandas().sort_values("seq")
    assert list(whole["threshold"]) == list(out["threshold"])


def test_calibrator_recovers_the_normal_curve(spark):
    raw = spark.createDataFrame(pd.DataFrame(
        {"raw": np.random.default_rng(4).normal(size=60_000)}))
    grid = A.Calibration(A.ecdf_fit(raw).toPandas())
    at = lambda x: float(grid.apply(np.array([x]))[0])
    assert at(0) == pytest.approx(.5, abs=.01)
    assert at(1) == pytest.approx(.8413, abs=.01)
    assert at(1.96) == pytest.approx(.975, abs=.01)
    xs = np.linspace(-5, 50, 500)
    ys = grid.apply(xs)
    assert (np.diff(ys) >= 0).all() and at(8) < at(40) < 1 and at(1e6) < 1


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"a": rng.normal(size=3001), "b": rng.integers(0, 5, 3001)})
    df = spark.createDataFrame(pdf)
    got = {r["column"]: r for r in Q.column_quantiles(df, ["a", "b"], (.05, .5, .95)).collect()}
    for c in ("a", "b"):
        want = np.quantile(pdf[c], [.05, .5, .95])
        assert [got[c][f"q{i}"] for i in range(3)] == pytest.approx(list(want))
    grid = Q.grid_quantiles(df, "a", 2001, .999).toPandas().sort_values("i")
    assert list(grid["value"]) == pytest.approx(
        list(np.quantile(pdf["a"], np.linspace(0, .999, 2001))))


def test_quantiles_of_unknown_and_equal_values(spark):
    df = spark.createDataFrame([(None, 4.0, 1.0)] * 5 + [(None, 4.0, None)] * 3, "a double, b double, c double")
    got = {r["column"]: (r.q0, r.q1) for r in Q.column_quantiles(df, ["a", "b", "c"], (.1, .9)).collect()}
    assert got == {"a": (None, None), "b": (4.0, 4.0), "c": (1.0, 1.0)}


def test_ranges_of_a_curve_are_even_where_scores_crowd(spark):
    """Running sums over scores that all lie above 0.99 do not meet in a few tasks."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        df = spark.range(20_000).select((1 - F.col("id") / 2e6 - 1e-9).alias("score"), (F.col("id") % 3 == 0).alias("truth"))
        curve = E.pr_curve(df)
        sizes = [r["count"] for r in curve.groupBy(F.input_file_name()).count().collect()]
        ordered = curve.orderBy(F.col("score").desc()).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(sizes) == 8 and max(sizes) < 2 * 20_000 / 8
    assert [r.seen for r in ordered] == list(range(1, 20_001)) and [r.tp for r in ordered[:4]] == [1, 1, 1, 2]


@pytest.fixture(scope="module")
def trained(spark):
    rng = np.random.default_rng(6)
    n = 3000
    pdf = pd.DataFrame({"id": np.arange(n), "x": rng.normal(10, 2, n), "y": rng.normal(0, 1, n),
                        "z": rng.normal(5, .1, n)})
    benign = spark.createDataFrame(pdf)
    return D.fit_anomaly(benign, ("x", "y", "z"), trees=60, sample=256), pdf


def attackers(spark):
    return spark.createDataFrame(
        [(1, 10.0, 0.0, 5.0), (2, 10.0, 0.0, 50.0), (3, 100.0, 30.0, 5.0)], "id long, x double, y double, z double")


def test_outliers_rank_first_and_scores_are_finite(spark, trained):
    model, _ = trained
    got = {r.id: r.score for r in D.anomaly_scores(attackers(spark), model).collect()}
    assert got[1] < .9 < got[2] < 1 and got[3] > .99


def test_explanation_names_the_odd_feature(spark, trained):
    model, _ = trained
    out = D.explained(D.anomaly_scores(attackers(spark), model), model).collect()
    lines = {r.id: r.contributions for r in out}
    assert lines[2][0].feature == "z" and lines[2][0].direction == "above"
    assert all(sum(c.impact for c in cs) <= 1.0001 for cs in lines.values())


def test_forest_does_not_depend_on_partitioning(spark, trained):
    _, pdf = trained
    vec = F.array(*[F.col(c).cast("float") for c in "xyz"])
    df = spark.createDataFrame(pdf).select("id", vec.alias("vec"))
    a = A.iforest_fit(df.repartition(1), 10, 128)
    b = A.iforest_fit(df.repartition(7), 10, 128)
    assert a.exceptAll(b).count() == 0
    assert {r.sample for r in a.collect()} == {128}


def test_model_round_trip_and_guards(spark, trained, tmp_path):
    model, _ = trained
    D.model_save(model, str(tmp_path / "m"))
    again = D.model_load(spark, str(tmp_path / "m"), ("x", "y", "z"))
    score = lambda m: sorted((r.id, r.score) for r in D.anomaly_scores(attackers(spark), m).collect())
    assert score(model) == score(again)
    with pytest.raises(ValueError):
        D.model_load(spark, str(tmp_path / "m"), ("x", "y"))


def test_parameters_are_validated():
    with pytest.raises(ValueError):
        Params(min_threshold=.9, base_threshold=.5)


def test_veto_never_silences_above_the_override(spark):
    df = spark.createDataFrame([(.99, "BENIGN", .95), (.998, "BENIGN", .95), (.99, "BENIGN", .5),
                                (.99, "C2_BEACON", .99)], "score double, family string, confidence double")
    got = df.select(SC.vetoable(F.col("score"), F.col("family"), F.col("confidence")).alias("v"))
    assert [r.v for r in got.collect()] == [True, False, False, False]


def test_average_precision_is_stepwise(spark):
    rows = [(True, .9), (False, .9), (True, .5), (False, .1)]
    df = spark.createDataFrame(rows, "truth boolean, score double")
    assert E.average_precision(df).first()[0] == pytest.approx(.5 * .5 + .5 * (2 / 3))
    assert E.roc_auc(df).first()[0] == pytest.approx((1.5 + 1) / 4)
