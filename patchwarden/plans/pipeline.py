"""Fit and infer: patches -> reduce -> whiten -> bank -> neighbours -> image scores."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import require_finite, vector_dim
from ..operators import coreset as B
from ..operators import knn as J
from ..operators import scoring as C
from ..operators import tail as T
from ..operators.moments import fourth_moment
from ..operators.reduction import PCAModel, pca_of
from ..operators.whitening import WhiteningConfig, WhiteningModel, whitening_of
from ..sources.scratch import written
from . import stages as S
from .registry import build_bank, check_bank

#: bytes of a bank that is kept as a local table
SMALL_BANK = 32 << 20
IMAGE_MODES = ("GLOBAL_ONLY", "TOPK_SOFT", "TOPP_MEAN")


@dataclass(frozen=True)
class FitConfig:
    contract: str = "STREAMING"
    pca_ratio: float | None = None
    whitening: WhiteningConfig | None = field(default_factory=WhiteningConfig)
    bank: str = "kcenter"
    n_clusters: int | str = 1000
    cluster_range: tuple[int, int] | str = "auto"
    enforce: bool = True
    chunk: int = 256
    threshold: float | None = None
    coreset_share: float = 0.1
    tail: T.TailConfig | None = None
    epochs: int = 1
    k: int = 1
    scorer: str = "eq7"
    reweight: int = 9
    mode: str = "GLOBAL_ONLY"
    top_k: int = 5
    temperature: float = 1.0
    top_p: float = 0.9
    max_k: int = 32
    seed: int = 0
    self_distances: bool = False

    def __post_init__(self):
        if self.contract not in ("OFFLINE", "STREAMING"):
            raise ValueError(f"unknown contract {self.contract}")
        check_bank(self.bank, self.contract)
        if self.bank == "tail_aware" and self.tail is None:
            raise ValueError("tail_aware needs its configuration")
        if self.epochs < 1 or self.k < 1 or self.reweight < 1:
            raise ValueError("epochs, k and reweight must be positive")
        if self.epochs > 1 and self.bank not in ("tail_aware",) and self.contract == "OFFLINE":
            raise ValueError("several passes are for streams")
        if self.scorer not in ("eq7", "max"):
            raise ValueError(f"unknown scorer {self.scorer}")
        if self.mode not in IMAGE_MODES:
            raise ValueError(f"unknown mode {self.mode}")
        if self.self_distances and self.scorer == "eq7":
            raise ValueError("support reweighting needs a plain bank, without self distances")


@dataclass
class Model:
    config: FitConfig
    pca: PCAModel | None
    whitening: WhiteningModel | None
    bank: DataFrame
    telemetry: dict[str, int] = field(default_factory=dict)

    def transform(self, patches: DataFrame) -> DataFrame:
        """Reduced and whitened features in place of the raw ones."""
        x = patches
        if self.pca is not None:
            x = self.pca.transform(x, "features", "__r").withColumn("features", F.col("__r")).drop("__r")
        if self.whitening is not None:
            x = self.whitening.transform(x, "features", "__z").withColumn("features", F.col("__z")).drop("__z")
        return x

    def neighbours(self, patches: DataFrame) -> tuple[DataFrame, DataFrame]:
        z = self.transform(patches.select("image_idx", "patch_pos", "features"))
        return z, J.query_bank(z, self.bank, self.config.k)

    def patch_scores(self, patches: DataFrame) -> DataFrame:
        return J.patch_scores(self.neighbours(patches)[1], ["image_idx", "patch_pos"])

    def image_scores(self, patches: DataFrame) -> DataFrame:
        """(image_idx, score)."""
        c = self.config
        z, near = self.neighbours(patches)
        if c.scorer == "eq7":
            if c.mode == "TOPK_SOFT":
                return C.eq7_top_k_soft(near, z, self.bank, c.reweight, c.top_k, c.temperature)
            if c.mode == "TOPP_MEAN":
                return C.eq7_top_p_mean(near, z, self.bank, c.reweight, c.top_p, c.max_k)
            return C.eq7_image(near, z, self.bank, c.reweight).select("image_idx", "score")
        scores = J.patch_scores(near, ["image_idx", "patch_pos"])
        if c.mode == "TOPK_SOFT":
            return C.top_k_soft(scores, c.top_k, c.temperature)
        if c.mode == "TOPP_MEAN":
            return C.top_p_mean(scores, c.top_p, c.max_k)
        return C.image_max(scores)

    def save(self, path: str) -> None:
        """The bank as Parquet and the rest as one JSON row: no pickles."""
        spark = self.bank.sparkSession
        self.bank.write.mode("overwrite").parquet(f"{path}/bank")
        arrays = lambda o: None if o is None else {k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in vars(o).items()}
        state = {"config": asdict(self.config), "pca": arrays(self.pca), "whitening": arrays(self.whitening), "telemetry": self.telemetry}
        spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.mode("overwrite").parquet(f"{path}/state")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Model:
        state = json.loads(spark.read.parquet(f"{path}/state").first().state)
        missing = {"config", "pca", "whitening"} - set(state)
        if missing:
            raise ValueError(f"the saved state lacks {sorted(missing)}")
        c = state["config"]
        c["whitening"] = WhiteningConfig(**c["whitening"]) if c["whitening"] else None
        c["tail"] = T.TailConfig(**c["tail"]) if c["tail"] else None
        c["cluster_range"] = tuple(c["cluster_range"]) if isinstance(c["cluster_range"], list) else c["cluster_range"]
        back = lambda kind, d: None if d is None else kind(**{k: np.array(v) if isinstance(v, list) else v for k, v in d.items()})
        return Model(FitConfig(**c), back(PCAModel, state["pca"]), back(WhiteningModel, state["whitening"]), spark.read.parquet(f"{path}/bank"), state.get("telemetry", {}))


def pinned(bank: DataFrame) -> DataFrame:
    """A bank computed once: written, as a greedy one grows with the rows; a small one then as a local table, whose size later joins know."""
    table = written(bank, "bank")
    if table.count() * vector_dim(table, "features") * 8 > SMALL_BANK:
        return table
    return bank.sparkSession.createDataFrame(table.orderBy("bank_id").collect(), table.schema)


def fit(patches: DataFrame, config: FitConfig, batch: str = "batch", order: str = "vec_id", folder: str | None = None) -> Model:
    """Fit on patches (batch, order, features). Moments are one distributed pass; with PCA the
    reduced moments follow from it without another one. folder: a shared folder that keeps each fitted stage, so that a fit which
    stopped goes on at its stage (``stages``)."""
    c = config
    spark = patches.sparkSession
    x = patches.select(F.col(batch).alias("batch"), F.col(order).alias("seq"), "features")
    staged = S.StagedFit(spark, c, folder)

    def moments() -> S.MomentsStageModel:
        require_finite(x, "features")
        return S.MomentsStage().fit(x)

    needs = c.pca_ratio is not None or c.whitening is not None
    m = staged.step("moments", moments).moments if needs else None
    if not needs:
        require_finite(x, "features")
    pca = staged.step("reduction", lambda: S.ReductionStageModel.of(None if c.pca_ratio is None else pca_of(m, c.pca_ratio))).model

    def whitened() -> S.WhiteningStageModel:
        if c.whitening is None:
            return S.WhiteningStageModel.of(None)
        own = m if pca is None else replace(m, mean=np.zeros(len(w := pca.components)), m2=w @ m.m2 @ w.T)
        reduced = pca.transform(x, "features", "r") if pca is not None else x.withColumn("r", F.col("features"))
        fourth = fourth_moment(reduced, "r", own.mean) if c.whitening.method == "LEDOIT_WOLF" and c.contract == "OFFLINE" else None
        return S.WhiteningStageModel.of(whitening_of(own.repeated(c.epochs), c.whitening, fourth))

    whitening = staged.step("whitening", whitened).model
    model = Model(c, pca, whitening, x)

    def bank() -> S.BankStageModel:
        z = model.transform(x)
        n = B.cluster_count(c.n_clusters, c.cluster_range, c.contract, 0 if c.contract == "STREAMING" else z.count())
        telemetry: dict[str, int] = {}
        rows = pinned(build_bank(z, c, n, telemetry))
        size = rows.count()
        B.enforce_budget(rows, size if c.bank == "greedy" else n if c.bank != "tail_aware" else c.tail.k, c.enforce, c.contract)
        return S.BankStageModel({"telemetry": telemetry | {"rows": size, "budget": n}}, pinned(J.materialize_bank(rows, True)) if c.self_distances else rows)

    last = staged.step("bank", bank)
    model.bank, model.telemetry = last.rows if folder is None else pinned(last.rows), last.values["telemetry"]
    return model
