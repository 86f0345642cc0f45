"""Stages of a fit: each fitted, exported and loaded alone; a fit that stopped goes on at its stage."""

import json

import numpy as np
import pytest
from pyspark.ml import Pipeline

from patchwarden.operators.whitening import WhiteningConfig
from patchwarden.plans import pipeline as P
from patchwarden.plans import stages as S

RNG = np.random.default_rng(21)
X = RNG.normal(size=(120, 6)) @ np.diag([5, 3, 2, 1, 1, 0.2])
CONFIG = P.FitConfig(n_clusters=12, chunk=8, pca_ratio=0.95, reweight=3)


@pytest.fixture(scope="module")
def patches(spark):
    return spark.createDataFrame([(i, i // 10, i // 20, i % 20, [float(v) for v in r]) for i, r in enumerate(X)], "vec_id long, batch long, image_idx long, patch_pos int, features array<double>").cache()


def same(a, b):
    assert a.config == b.config and a.telemetry == b.telemetry
    for x, y in ((a.pca, b.pca), (a.whitening, b.whitening)):
        assert (x is None) == (y is None)
        for k in vars(x) if x is not None else ():
            assert np.array_equal(getattr(x, k), getattr(y, k)), k
    assert sorted(map(str, a.bank.collect())) == sorted(map(str, b.bank.collect()))


def scores(model, patches):
    return {r.image_idx: r.score for r in model.image_scores(patches).collect()}


@pytest.mark.parametrize("stop", ["whitening_of", "build_bank"])
def test_a_fit_that_stopped_goes_on_at_its_stage(spark, patches, tmp_path, monkeypatch, stop):
    want = P.fit(patches, CONFIG)
    folder = f"file://{tmp_path}/fit"

    def broken(*a, **k):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(P, stop, broken)
        with pytest.raises(RuntimeError):
            P.fit(patches, CONFIG, folder=folder)
    done = {"whitening_of": ["moments", "reduction"], "build_bank": ["moments", "reduction", "whitening"]}[stop]
    assert sorted(p.name for p in (tmp_path / "fit").iterdir()) == sorted(done)
    with monkeypatch.context() as m:  # the rows are not read again for what is there
        m.setattr(S, "fit_moments", broken)
        m.setattr(P, "pca_of", broken)
        if stop == "build_bank":
            m.setattr(P, "whitening_of", broken)
        got = P.fit(patches, CONFIG, folder=folder)
    same(got, want)
    with monkeypatch.context() as m:  # all there: nothing is fitted
        m.setattr(P, "build_bank", broken)
        same(P.fit(patches, CONFIG, folder=folder), want)
    a, b = scores(got, patches), scores(want, patches)
    assert a.keys() == b.keys() and all(np.isclose(a[k], b[k]) for k in a)


@pytest.mark.parametrize("change,stage", [({"pca_ratio": 0.5}, "reduction"), ({"whitening": None}, "whitening"), ({"n_clusters": 5}, "bank"), ({"seed": 3}, "bank")])
def test_another_configuration_is_refused_at_its_stage(patches, tmp_path, change, stage):
    from dataclasses import replace

    P.fit(patches, CONFIG, folder=f"file://{tmp_path}")
    with pytest.raises(ValueError, match=f"{stage} was fitted with another configuration"):
        P.fit(patches, replace(CONFIG, **change), folder=f"file://{tmp_path}")
    P.fit(patches, replace(CONFIG, k=2), folder=f"file://{tmp_path}")  # no stage depends on it


def test_stages_alone(spark, patches, tmp_path):
    """Estimators and models of the ml library: in a pipeline, exported and loaded alone."""
    model = Pipeline(stages=[S.ReductionStage(0.95), S.WhiteningStage(WhiteningConfig(method="FIXED", shrinkage=0.1))]).fit(patches)
    z = np.array([r.features for r in model.transform(patches).orderBy("vec_id").collect()])
    for k, m in enumerate(model.stages):
        m.export(spark, f"file://{tmp_path}/{k}", {"of": k})
    first, second = (kind.load(spark, f"file://{tmp_path}/{k}", {"of": k}) for k, kind in enumerate((S.ReductionStageModel, S.WhiteningStageModel)))
    again = np.array([r.features for r in second.transform(first.transform(patches)).orderBy("vec_id").collect()])
    assert np.array_equal(z, again) and z.shape[1] < 6
    bank = S.BankStageModel({"telemetry": {"rows": 2}}, patches.select("vec_id", "features").limit(2))
    bank.export(spark, f"file://{tmp_path}/bank")
    assert S.BankStageModel.load(spark, f"file://{tmp_path}/bank").rows.count() == 2
    none = S.WhiteningStageModel.of(None)
    none.export(spark, f"file://{tmp_path}/none")
    assert S.WhiteningStageModel.load(spark, f"file://{tmp_path}/none").model is None
    m = S.MomentsStage().fit(patches)
    assert m.moments.n == 120 and np.allclose(m.moments.cov, np.cov(X.T))


def test_states_are_strict(spark, patches, tmp_path):
    path = f"file://{tmp_path}/x"
    S.MomentsStage().fit(patches).export(spark, path)
    state = json.loads(spark.read.parquet(f"{path}/state").first()[0])
    with pytest.raises(ValueError, match="this is the state of moments"):
        S.WhiteningStageModel.load(spark, path)
    wrong = [state | {"more": 1}, {k: v for k, v in state.items() if k != "depends"}, state | {"version": 2}, state | {"values": {"n": 1}}, state | {"values": state["values"] | {"z": 1}}]
    for w in wrong:
        spark.createDataFrame([(json.dumps(w),)], "state string").write.mode("overwrite").parquet(f"{path}/state")
        with pytest.raises(ValueError):
            S.MomentsStageModel.load(spark, path)
    with pytest.raises(TypeError):
        S.StagedFit(spark, CONFIG).step("bank", lambda: S.MomentsStageModel({"n": 0, "mean": None, "m2": None}))
