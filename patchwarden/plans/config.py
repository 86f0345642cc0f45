"""Run configurations in YAML: strict reading, defaults, and checks of what fits together.

Layout: experiment, paths, runtime, pipeline.training, pipeline.slots (twelve slots with plugin
and params), evaluation, artifacts, render. Unknown keys are refused everywhere."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from ..operators.calibration import check_mode
from ..operators.tail import TailConfig
from ..operators.whitening import WhiteningConfig
from ..sources.images import Augmentation, LoaderConfig
from . import capabilities
from .pipeline import FitConfig

EPOCH_STAGES = ("feature_agg", "proj1", "transform", "proj2", "mem_agg")
THRESHOLDS = ("best_f1_per_dataset", "fixed_0_5")
SAVE_MODES = ("all", "anomalous", "top_k")


@dataclass(frozen=True)
class Evaluation:
    image_threshold: str = "best_f1_per_dataset"
    pixel_threshold: str = "best_f1_per_dataset"
    calibration: str = "none"
    eps: float = 1e-12
    calibrate_image: bool = True
    calibrate_pixel: bool = True
    image_aupro: bool = True
    pixel_aupro: bool = False
    max_fpr: float = 0.3
    num_thresholds: int = 256


@dataclass(frozen=True)
class RunConfig:
    name: str
    seed: int
    output_root: str
    loader: LoaderConfig
    train_augment: bool
    backbone: str
    layers: tuple[str, ...]
    patch: int
    stride: int
    pre_dim: int
    dim: int
    fit: FitConfig
    evaluation: Evaluation
    artifacts: dict[str, Any]


class _Section:
    """A mapping whose keys are taken one by one; what is left over is an error."""

    def __init__(self, value: Any, name: str):
        if value is None:
            value = {}
        if not isinstance(value, dict):
            raise ValueError(f"{name} must be a mapping")
        self.left, self.name = dict(value), name

    def take(self, key: str, default: Any = ..., kind: type | tuple | None = None, among: tuple = ()) -> Any:
        if key not in self.left:
            if default is ...:
                raise ValueError(f"{self.name}.{key} is missing")
            return default
        v = self.left.pop(key)
        if kind is not None and (not isinstance(v, kind) or isinstance(v, bool) and bool not in (kind if isinstance(kind, tuple) else (kind,))):
            raise ValueError(f"{self.name}.{key} has the wrong type")
        if isinstance(v, str) and among:  # tokens are read without case and outer white space
            v = {str(a).lower(): a for a in among}.get(v.strip().lower(), v)
        if among and v not in among:
            raise ValueError(f"{self.name}.{key} must be one of {', '.join(map(str, among))}")
        return v

    def section(self, key: str) -> _Section:
        return _Section(self.left.pop(key, None), f"{self.name}.{key}")

    def done(self) -> None:
        if self.left:
            raise ValueError(f"unknown keys in {self.name}: {', '.join(map(str, sorted(self.left)))}")


def load(path: str) -> RunConfig:
    with open(path) as f:
        return parse(f.read())


def parse(text: str) -> RunConfig:
    import yaml

    root = _Section(yaml.safe_load(text), "config")
    e = root.section("experiment")
    name, seed = e.take("name", kind=str), e.take("seed", 0, int)
    e.done()
    p = root.section("paths")
    output = p.take("output_root", "results", str)
    p.done()
    r = root.section("runtime")
    r.take("device", "auto", str, ("auto", "cpu"))
    r.done()
    pipe = root.section("pipeline")
    training = pipe.section("training")
    contract = training.take("contract", kind=str, among=("OFFLINE", "STREAMING"))
    ep = training.section("fit_epochs")
    epochs = {s: ep.take(s, kind=int) for s in EPOCH_STAGES}
    ep.done()
    training.done()
    slots = pipe.section("slots")
    plugin, params = {}, {}
    for s in capabilities.SLOTS:
        one = slots.section(s)
        plugin[s] = one.take("plugin", kind=str, among=capabilities.plugins(s))
        params[s] = one.section("params")
        one.done()
    slots.done()
    pipe.done()
    capabilities.check(plugin, contract)
    loader, train_augment = _loader(params["dataloader"], seed)
    b = params["backbone"]
    backbone, layers = b.take("backbone", kind=str), tuple(b.take("embedding_layers", kind=list))
    a = params["patch_align"]
    patch, stride = a.take("patchsize", 3, int), a.take("patchstride", 1, int)
    pre = params["preprocess"].take("pretrain_embed_dimension", kind=int)
    f = params["feature_agg"]
    dim = f.take("target_embed_dimension", kind=int)
    ratio = float(f.take("pca_variance_ratio", 0.99, (int, float))) if plugin["feature_agg"] == "ipca" else None
    if min(patch, stride, pre, dim) < 1 or ratio is not None and not 0 < ratio <= 1:
        raise ValueError("patch sizes and dimensions must be positive, the variance ratio in (0, 1]")
    fit = _fit(plugin, params, contract, epochs, ratio, seed)
    fit = replace(fit, self_distances=params["materialize"].take("compute_self_distances", False, bool))
    for s in params.values():
        s.done()
    evaluation = _evaluation(root.section("evaluation"), contract)
    art = root.section("artifacts")
    artifacts = {"enabled": art.take("enabled", False, bool), "split": art.take("split", "test", str, ("test",)), "save_mode": art.take("save_mode", "all", str, SAVE_MODES), "max_images": art.take("max_images_per_dataset", None), "alpha": float(art.take("overlay_alpha", 0.55, (int, float)))}
    if not 0 <= artifacts["alpha"] <= 1:
        raise ValueError("overlay_alpha must be in [0, 1]")
    art.done()
    render = root.section("render")
    progress = render.section("progress")
    for k in ("enabled", "leave", "dynamic_ncols", "min_interval"):
        progress.take(k, None)
    progress.done()
    logging = render.section("logging")
    logging.take("level", "INFO", str)
    logging.done()
    render.done()
    root.done()
    return RunConfig(name, seed, output, loader, train_augment, backbone, layers, patch, stride, pre, dim, fit, evaluation, artifacts)


def _loader(d: _Section, seed: int) -> tuple[LoaderConfig, bool]:
    root, categories = d.take("dataset_root", kind=str), d.take("categories", kind=list)
    size = d.take("img_size", [224, 224], list)
    if len(size) != 2:
        raise ValueError("img_size is a pair")
    if d.take("num_workers", 0, int) < 0:
        raise ValueError("num_workers must not be negative")
    if any(v < 0 for v in d.take("train_augment_seed_devices", [], list)):
        raise ValueError("seed devices must not be negative")
    enabled = d.take("train_augment_enabled", False, bool)
    policy = d.take("streaming_augmentation_policy", "independent", str)
    base = _augmentation(d.section("train_augment_cfg"))
    per = {c: _augmentation(_Section(v, c)) for c, v in d.section("train_augment_overrides").left.items()}
    kept = LoaderConfig(root, tuple(categories), d.take("batch_size", 16, int), crop=tuple(size), seed=d.take("seed", seed, int), policy=policy if enabled else "none", augment=Augmentation(**base), per_category=per)
    return kept, enabled


def _augmentation(s: _Section) -> dict:
    """hflip, vflip, rotate, random90, color_jitter with their probabilities."""
    out: dict[str, Any] = {}
    for key, name in (("hflip", "hflip"), ("vflip", "vflip"), ("rotate", "rotate"), ("random90", "random90"), ("color_jitter", "jitter")):
        if key not in s.left:
            continue
        one = s.section(key)
        on = one.take("enable", True, bool)
        p = float(one.take("p", 0.5, (int, float)))
        if not 0 <= p <= 1:
            raise ValueError(f"{one.name}.p must be in [0, 1]")
        out[name] = p if on else 0.0
        if key == "rotate":
            out["degrees"] = float(one.take("limit", 30.0, (int, float)))
        if key == "color_jitter":
            out["strengths"] = tuple(float(one.take(k, v, (int, float))) for k, v in (("brightness", 0.2), ("contrast", 0.2), ("saturation", 0.2), ("hue", 0.1)))
        one.done()
    s.done()
    return out


def _fit(plugin: dict, params: dict, contract: str, epochs: dict, ratio: float | None, seed: int) -> FitConfig:
    if min(epochs.values()) < 1:
        raise ValueError("every stage needs a pass")
    whitening = None
    t = params["transform"]
    if plugin["transform"] == "cholesky":
        c = t.section("covariance_regularization")
        f = lambda k, d: float(c.take(k, d, (int, float)))
        whitening = WhiteningConfig(c.take("enabled", True, bool), c.take("method", "OAS", str), c.take("shrinkage", "auto"), f("eigen_floor_ratio", 1e-8), f("min_jitter", 1e-12), f("max_jitter", 1.0), f("jitter_multiplier", 10.0), t.take("storage_precision", "float64", str))
        c.done()
    m, kind = params["mem_agg"], plugin["mem_agg"]
    more: dict[str, Any] = {}
    if kind == "greedy":
        more = {"bank": "greedy", "coreset_share": float(m.take("coreset_percentage", 0.1, (int, float)))}
        if not 0 < more["coreset_share"] < 1:
            raise ValueError("coreset_percentage must be in (0, 1)")
    else:
        span = m.take("cluster_range", "auto")
        more = {"n_clusters": m.take("n_clusters", "auto"), "cluster_range": tuple(span) if isinstance(span, list) else span, "enforce": m.take("streaming_enforce_cluster_budget", True, bool)}
        if kind == "kmeans":
            more["bank"] = "kmeans"
        elif kind == "kcenter":
            mode = m.take("kcenter_mode", "budgeted", str, ("budgeted", "merge_reduce"))
            more |= {"bank": "budgeted" if mode == "budgeted" else "kcenter", "chunk": m.take("kcenter_chunk_coreset_size", 256, int), "threshold": m.take("kcenter_distance_threshold", None)}
        else:
            k = more["n_clusters"] if more["n_clusters"] != "auto" else (1000 if more["cluster_range"] == "auto" else more["cluster_range"][1])
            strategy = m.take("tail_selection_strategy", kind=str)
            more |= {"bank": "tail_aware", "tail": TailConfig(
                k=int(k), strategy=strategy, main_fraction=float(m.take("main_budget_fraction", 0.85, (int, float))), pool=m.take("geometric_candidate_pool_size", None if strategy == "chi2_band" else ...),
                p_min=float(m.take("tail_probability_min", 0.0, (int, float))), p_max=float(m.take("tail_probability_max", 0.05, (int, float))), phase1_passes=m.take("phase1_passes", 1, int), epochs=epochs["mem_agg"],
                dedup={"quantized_row": "quantized", "norm_tolerance": "tolerance"}.get(x := m.take("deduplication_strategy", kind=str, among=("exact_row", "quantized_row", "norm_tolerance")), x), decimals=m.take("dedup_quantization_decimals", 6, int), eps=float(m.take("dedup_norm_tolerance", 0.0, (int, float))), chunk=m.take("kcenter_chunk_coreset_size", 256, int),
            )}
    if kind != "tail_aware_kcenter" and epochs["mem_agg"] > 1 and kind != "kmeans":
        raise ValueError(f"{kind} takes one pass")
    s = params["scoring"]
    scorer = "eq7" if plugin["scoring"] == "paper_eq7" else "max"
    reweight = s.take("paper_reweight_num_nn", 9, int)
    ps = s.section("patch_scoring")
    mode = ps.take("mode", "GLOBAL_ONLY", str)
    modes = {"GLOBAL_ONLY": "GLOBAL_ONLY", "GLOBAL_TOPK_SOFT": "TOPK_SOFT", "GLOBAL_TOPP_MEAN": "TOPP_MEAN"}
    if mode.startswith("PNI"):
        raise ValueError(f"{mode} needs fitted priors, which no plugin provides; use operators.scoring.pni_gate")
    if mode not in modes:
        raise ValueError(f"unknown patch scoring mode {mode}")
    pni = ps.section("pni")
    picked: dict[str, Any] = {}
    allowed = {"TOPK_SOFT": {"topk_k": "top_k", "topk_temperature": "temperature"}, "TOPP_MEAN": {"topp_p": "top_p", "topp_max_k": "max_k"}}.get(modes[mode], {})
    for key, to in allowed.items():
        if key in pni.left:
            picked[to] = pni.left.pop(key)
    pni.done()
    ps.done()
    k = params["distance"].take("k", 1, int)
    return FitConfig(contract=contract, pca_ratio=ratio, whitening=whitening, epochs=epochs["transform"], k=k, scorer=scorer, reweight=reweight, mode=modes[mode], seed=seed, **picked, **more)


def _evaluation(e: _Section, contract: str) -> Evaluation:
    t = e.section("threshold_policy")
    image, pixel = (t.take(k, THRESHOLDS[0], str, THRESHOLDS) for k in ("image", "pixel"))
    t.done()
    c = e.section("calibration")
    mode = c.take("mode", "none", str)
    check_mode(mode, contract)
    eps = float(c.take("eps", 1e-12, (int, float)))
    ci, cp = c.take("apply_to_image", True, bool), c.take("apply_to_pixel", True, bool)
    c.done()
    m = e.section("pixel_metrics")
    a = m.section("aupro")
    out = Evaluation(image, pixel, mode, eps, ci, cp, a.take("image_enabled", True, bool), a.take("pixel_enabled", False, bool), float(a.take("max_fpr", 0.3, (int, float))), a.take("num_thresholds", 256, int))
    a.done()
    m.done()
    e.done()
    if eps <= 0 or not 0 < out.max_fpr <= 1 or out.num_thresholds < 8:
        raise ValueError("eps must be positive, max_fpr in (0, 1], num_thresholds 8 or more")
    return out
