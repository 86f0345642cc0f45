"""Declarations of plugins, and what speaks against a selection of them."""

import pytest

from patchwarden.plans import capabilities as K
from patchwarden.plans import config

GOOD = {
    "dataloader": "mvtec_dataloader_augment", "backbone": "pretrained_backbone", "patch_align": "pc_patchify_align", "preprocess": "pc_preprocess", "feature_agg": "ipca", "proj1": "none", "transform": "cholesky", "proj2": "none", "mem_agg": "kcenter",
    "materialize": "kcenter", "distance": "euclidean_nn", "scoring": "paper_eq7",
}


@pytest.fixture
def declared():
    made = []

    def declare(slot, name, **flags):
        K.declare(slot, name, K.Capability(**{"streaming": True, "full_dataset": False, **flags}))
        made.append((slot, name))

    yield declare
    for m in made:
        K.withdraw(*m)


def test_shipped_selections():
    for contract in ("OFFLINE", "STREAMING"):
        for slot in K.SLOTS:
            for name in K.plugins(slot):
                found = K.problems(GOOD | {slot: name}, contract)
                assert found == ([] if name != "greedy" or slot != "mem_agg" or contract == "OFFLINE" else ["mem_agg.greedy does not work on streams", "mem_agg.greedy needs all rows at once"])
    assert all(K.plugins(s) for s in K.SLOTS) and len(K.SLOTS) == 12


def test_each_rejection(declared):
    declared("mem_agg", "keeps all", full_dataset=True)
    declared("feature_agg", "batch only", streaming=False)
    for slot, name, said in (("mem_agg", "keeps all", "mem_agg.keeps all needs all rows at once"), ("feature_agg", "batch only", "feature_agg.batch only does not work on streams"), ("scoring", "x", "scoring.x declares no capabilities")):
        with pytest.raises(ValueError, match=said):
            K.check(GOOD | {slot: name}, "STREAMING")
    K.check(GOOD | {"mem_agg": "keeps all"}, "OFFLINE")
    assert K.problems({k: v for k, v in GOOD.items() if k != "proj2"}, "OFFLINE") == ["no plugin for proj2"]
    assert K.problems(GOOD | {"proj3": "none"}, "OFFLINE") == ["unknown slot proj3"]
    assert K.problems(GOOD, "SOMETIMES") == ["unknown contract SOMETIMES"]


def test_frontier_of_places(declared):
    local = {"needs_places": True, "keeps_places": True}
    declared("mem_agg", "local bank", **local)
    declared("materialize", "local", keeps_places=True)
    declared("distance", "same place", **local)
    declared("scoring", "by place", keeps_places=True)
    mixed = GOOD | {"mem_agg": "local bank"}
    assert K.problems(mixed, "STREAMING") == [f"{s}.{GOOD[s]} loses the places that mem_agg.local bank needs" for s in ("materialize", "distance", "scoring")]
    assert K.problems(GOOD | {"mem_agg": "local bank", "materialize": "local", "distance": "same place", "scoring": "by place"}, "STREAMING") == []
    assert K.problems(GOOD | {"distance": "same place"}, "OFFLINE") == ["scoring.paper_eq7 loses the places that distance.same place needs"]  # what stands before needs none
    declared("proj1", "mixes", keeps_places=False)
    assert K.problems(GOOD | {"proj1": "mixes", "distance": "same place", "scoring": "by place"}, "OFFLINE") == []


@pytest.mark.parametrize("bad,kind", [({"streaming": 1, "full_dataset": False}, TypeError), ({"streaming": True, "full_dataset": None}, TypeError), ({"streaming": True, "full_dataset": False, "needs_places": True}, ValueError), ({"streaming": True}, TypeError)])
def test_bad_declarations(bad, kind):
    with pytest.raises(kind):
        K.Capability(**bad)


def test_declared_once():
    with pytest.raises(ValueError):
        K.declare("mem_agg", "greedy", K.Capability(True, False))
    with pytest.raises(ValueError):
        K.declare("nowhere", "x", K.Capability(True, False))
    with pytest.raises(TypeError):
        K.declare("mem_agg", "x", {"streaming": True})


def test_configuration_is_analysed_before_any_job(declared):
    from test_plans import YAML

    assert config.parse(YAML)
    greedy = YAML.replace("mem_agg: {plugin: kcenter, params: {n_clusters: 30, kcenter_mode: merge_reduce, kcenter_chunk_coreset_size: 16}}", "mem_agg: {plugin: greedy}")
    with pytest.raises(ValueError, match="mem_agg.greedy does not work on streams; mem_agg.greedy needs all rows at once"):
        config.parse(greedy)
    assert config.parse(greedy.replace("contract: STREAMING", "contract: OFFLINE")).fit.bank == "greedy"
    declared("mem_agg", "mine")
    with pytest.raises(ValueError):  # declared, but nothing builds it
        config.parse(YAML.replace("mem_agg: {plugin: kcenter", "mem_agg: {plugin: yours"))
