"""What plugins of the twelve slots declare of themselves, and one pass over a selection of them before any job runs.

A plugin declares whether it works on streams, whether it needs all rows at once, and, behind the features, whether it needs the place of each vector and whether it
keeps it. The first plugin that needs places is the frontier: what stands behind it must keep them, or the places that it relied on are gone."""

from __future__ import annotations

from dataclasses import dataclass, fields

#: fixed values: the slots, in the order in which vectors pass them; those from LOCAL_FROM on see vectors with places
SLOTS = ("dataloader", "backbone", "patch_align", "preprocess", "feature_agg", "proj1", "transform", "proj2", "mem_agg", "materialize", "distance", "scoring")
LOCAL_FROM = SLOTS.index("proj1")


@dataclass(frozen=True)
class Capability:
    streaming: bool
    full_dataset: bool
    needs_places: bool = False
    keeps_places: bool = False

    def __post_init__(self):
        for f in fields(self):
            if not isinstance(getattr(self, f.name), bool):
                raise TypeError(f"{f.name} is true or false, not {getattr(self, f.name)!r}")
        if self.needs_places and not self.keeps_places:
            raise ValueError("a plugin that needs places must keep them")


_declared: dict[tuple[str, str], Capability] = {}


def declare(slot: str, plugin: str, capability: Capability) -> None:
    if slot not in SLOTS:
        raise ValueError(f"unknown slot {slot}; slots are {', '.join(SLOTS)}")
    if not isinstance(capability, Capability):
        raise TypeError(f"{slot}.{plugin} declares a {type(capability).__name__}, not a Capability")
    if (slot, plugin) in _declared:
        raise ValueError(f"{slot}.{plugin} is declared already")
    _declared[slot, plugin] = capability


def withdraw(slot: str, plugin: str) -> None:
    del _declared[slot, plugin]


def capability(slot: str, plugin: str) -> Capability:
    if (slot, plugin) not in _declared:
        raise ValueError(f"{slot}.{plugin} declares no capabilities")
    return _declared[slot, plugin]


def plugins(slot: str) -> tuple[str, ...]:
    """Names of a slot's plugins, in order of declaration."""
    return tuple(p for s, p in _declared if s == slot)


def problems(selection: dict[str, str], contract: str) -> list[str]:
    """All that speaks against a selection (slot: plugin) under a contract."""
    if contract not in ("OFFLINE", "STREAMING"):
        return [f"unknown contract {contract}"]
    found = [f"no plugin for {s}" for s in SLOTS if s not in selection] + [f"unknown slot {s}" for s in selection if s not in SLOTS]
    frontier = None
    for k, slot in enumerate(SLOTS):
        if slot not in selection:
            continue
        name = f"{slot}.{selection[slot]}"
        try:
            c = capability(slot, selection[slot])
        except ValueError as e:
            found.append(str(e))
            continue
        if contract == "STREAMING" and not c.streaming:
            found.append(f"{name} does not work on streams")
        if contract == "STREAMING" and c.full_dataset:
            found.append(f"{name} needs all rows at once")
        if k < LOCAL_FROM:
            continue
        if frontier is not None and not c.keeps_places:
            found.append(f"{name} loses the places that {frontier} needs")
        if frontier is None and c.needs_places:
            frontier = name
    return found


def check(selection: dict[str, str], contract: str) -> None:
    """Raises ValueError with all problems of a selection."""
    found = problems(selection, contract)
    if found:
        raise ValueError("; ".join(found))


for _slot, _plugin in (("dataloader", "mvtec_dataloader_augment"), ("backbone", "pretrained_backbone"), ("patch_align", "pc_patchify_align"), ("preprocess", "pc_preprocess"), ("feature_agg", "ipca"), ("feature_agg", "none")):
    declare(_slot, _plugin, Capability(streaming=True, full_dataset=False))
for _slot, _plugin in (("proj1", "none"), ("transform", "cholesky"), ("transform", "none"), ("proj2", "none")):
    declare(_slot, _plugin, Capability(streaming=True, full_dataset=False, keeps_places=True))
for _slot, _plugin in (("mem_agg", "kcenter"), ("mem_agg", "kmeans"), ("mem_agg", "tail_aware_kcenter"), ("materialize", "greedy"), ("materialize", "kcenter"), ("materialize", "kmeans"), ("distance", "euclidean_nn"), ("scoring", "paper_eq7"), ("scoring", "reference_max")):
    declare(_slot, _plugin, Capability(streaming=True, full_dataset=False))
declare("mem_agg", "greedy", Capability(streaming=False, full_dataset=True))
