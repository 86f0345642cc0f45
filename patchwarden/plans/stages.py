"""The stages of a fit as estimators and models that are fitted, exported and loaded one by one.

A stage's model is a ``pyspark.ml`` model: its state is one JSON row (the bank's rows are a table beside it), written behind everything else, so what
is there is whole. ``StagedFit`` keeps the states of a fit in a shared folder; a fit that stopped goes on behind the last stage whose state is there, and does not
read the rows again for those before. A state names its stage, its version and the configuration that it depends on; other or missing keys are errors."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict
from typing import Any

import numpy as np
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.moments import Moments, fit_moments
from ..operators.reduction import PCAModel, pca_of
from ..operators.whitening import WhiteningConfig, WhiteningModel, whitening_of

VERSION = 1
_KEYS = {"stage", "version", "depends", "values"}


def _plain(v: Any) -> Any:
    return {"array": v.tolist(), "shape": list(v.shape)} if isinstance(v, np.ndarray) else v


def _back(v: Any) -> Any:
    return np.array(v["array"], float).reshape(v["shape"]) if isinstance(v, dict) and set(v) == {"array", "shape"} else v


class StageModel(Model):
    """A fitted stage: ``values`` by name, ``rows`` where the state is a table. Subclasses name the stage and its values."""

    stage = ""
    names: tuple[str, ...] = ()

    def __init__(self, values: dict[str, Any] | None = None, rows: DataFrame | None = None):
        super().__init__()
        self.values, self.rows = values or {}, rows
        if set(self.values) != set(self.names):
            raise ValueError(f"{self.stage} needs {sorted(self.names)}, not {sorted(self.values)}")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset

    def export(self, spark: SparkSession, path: str, depends: dict | None = None) -> None:
        if self.rows is not None:
            self.rows.write.mode("overwrite").parquet(f"{path}/rows")
        state = {"stage": self.stage, "version": VERSION, "depends": depends or {}, "values": {k: _plain(v) for k, v in self.values.items()}}
        spark.createDataFrame([(json.dumps(state, sort_keys=True),)], "state string").coalesce(1).write.mode("overwrite").parquet(f"{path}/state")

    @classmethod
    def load(cls, spark: SparkSession, path: str, depends: dict | None = None) -> StageModel:
        state = json.loads(spark.read.parquet(f"{path}/state").first()[0])
        if set(state) != _KEYS:
            raise ValueError(f"the state of {cls.stage} has the keys {sorted(state)}, not {sorted(_KEYS)}")
        if (state["stage"], state["version"]) != (cls.stage, VERSION):
            raise ValueError(f"this is the state of {state['stage']}, version {state['version']}, not of {cls.stage}, version {VERSION}")
        if depends is not None and state["depends"] != json.loads(json.dumps(depends)):
            raise ValueError(f"{cls.stage} was fitted with another configuration: {state['depends']}")
        rows = spark.read.parquet(f"{path}/rows") if cls is BankStageModel else None
        return cls({k: _back(v) for k, v in state["values"].items()}, rows)


class _OnColumn(Estimator):
    """An estimator on one vector column, ``features`` unless set."""

    column: Param[str] = Param(Params._dummy(), "column", "the vector column", TypeConverters.toString)

    def __init__(self, column: str = "features"):
        super().__init__()
        self._set(column=column)


class MomentsStageModel(StageModel):
    """n, mean and sum of squared deviations of the rows: changes nothing."""

    stage, names = "moments", ("n", "mean", "m2")

    @property
    def moments(self) -> Moments:
        return Moments(int(self.values["n"]), self.values["mean"], self.values["m2"])


class MomentsStage(_OnColumn):
    def _fit(self, dataset: DataFrame) -> MomentsStageModel:
        m = fit_moments(dataset, self.getOrDefault(self.column))
        return MomentsStageModel({"n": m.n, "mean": m.mean, "m2": m.m2})


class ReductionStageModel(StageModel):
    """Principal components in place of ``features``; without a model (an identity reduction) they stay."""

    stage, names = "reduction", ("mean", "components", "variances", "ratios")

    @classmethod
    def of(cls, model: PCAModel | None) -> ReductionStageModel:
        return cls({k: None if model is None else getattr(model, k) for k in cls.names})

    @property
    def model(self) -> PCAModel | None:
        return None if self.values["mean"] is None else PCAModel(**self.values)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        if self.model is None:
            return dataset
        return self.model.transform(dataset, "features", "__r").withColumn("features", F.col("__r")).drop("__r")


class ReductionStage(_OnColumn):
    """PCA to a share of the variance."""

    ratio: Param[float] = Param(Params._dummy(), "ratio", "the share of the variance that stays", TypeConverters.toFloat)

    def __init__(self, ratio: float = 0.99, column: str = "features"):
        super().__init__(column)
        self._set(ratio=ratio)

    def _fit(self, dataset: DataFrame) -> ReductionStageModel:
        return ReductionStageModel.of(pca_of(fit_moments(dataset, self.getOrDefault(self.column)), self.getOrDefault(self.ratio)))


class WhiteningStageModel(StageModel):
    """Whitened vectors in place of ``features``; without a model they stay."""

    stage, names = "whitening", ("mean", "inverse", "rho", "jitter")

    @classmethod
    def of(cls, model: WhiteningModel | None) -> WhiteningStageModel:
        return cls({k: None if model is None else getattr(model, k) for k in cls.names})

    @property
    def model(self) -> WhiteningModel | None:
        return None if self.values["mean"] is None else WhiteningModel(**self.values)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        if self.model is None:
            return dataset
        return self.model.transform(dataset, "features", "__z").withColumn("features", F.col("__z")).drop("__z")


class WhiteningStage(_OnColumn):
    def __init__(self, config: WhiteningConfig | None = None, column: str = "features"):
        super().__init__(column)
        self.config = config or WhiteningConfig()

    def _fit(self, dataset: DataFrame) -> WhiteningStageModel:
        return WhiteningStageModel.of(whitening_of(fit_moments(dataset, self.getOrDefault(self.column)), self.config, None))


class BankStageModel(StageModel):
    """The reference bank: rows (bank_id, features), and what its builder reported."""

    stage, names = "bank", ("telemetry",)


STAGES: dict[str, type[StageModel]] = {m.stage: m for m in (MomentsStageModel, ReductionStageModel, WhiteningStageModel, BankStageModel)}


class StagedFit:
    """The stages of one fit, in order. With a folder each fitted stage is exported, and one that is there already is loaded instead of
    fitted; without a folder stages are only fitted."""

    def __init__(self, spark: SparkSession, config: Any, folder: str | None = None):
        self.spark, self.folder = spark, folder
        self.config = {k: v for k, v in asdict(config).items()}
        self.fitted: list[str] = []

    #: what of the configuration each stage depends on, with all that those before it do
    DEPENDS = {"moments": (), "reduction": ("pca_ratio",), "whitening": ("contract", "whitening", "epochs"), "bank": ("bank", "n_clusters", "cluster_range", "chunk", "threshold", "coreset_share", "tail", "seed", "self_distances")}

    def depends(self, stage: str) -> dict:
        out: dict = {}
        for name, keys in self.DEPENDS.items():
            out |= {k: self.config[k] for k in keys}
            if name == stage:
                return out
        raise ValueError(f"unknown stage {stage}")

    def _there(self, path: str) -> bool:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/state/_SUCCESS")
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop)

    def step(self, stage: str, fit: Callable[[], StageModel]) -> StageModel:
        kind = STAGES[stage]
        path = None if self.folder is None else f"{self.folder}/{stage}"
        if path is not None and self._there(path):
            return kind.load(self.spark, path, self.depends(stage))
        model = fit()
        if not isinstance(model, kind):
            raise TypeError(f"{stage} is fitted to a {kind.__name__}, not a {type(model).__name__}")
        self.fitted.append(stage)
        if path is None:
            return model
        model.export(self.spark, path, self.depends(stage))
        return kind.load(self.spark, path, self.depends(stage))
