"""Signals as plugins: a driver-side catalog that orders them and prunes to what a query needs."""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from hashlib import sha256
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import materialised

#: Fixed values, in the order that breaks ties.
CATEGORIES = ["architectural-drift", "dependency-entropy", "abstraction-bloat", "legibility-decay", "generated-slop", "review-pain", "security-risk", "concurrency-safety", "behavior-preservation"]
TIER_CONFIDENCE = {1.0: 1.0, 1.5: 0.95, 2.0: 0.85}
MAX_DEPTH = 2


class RegistryError(ValueError):
    """A registry that can't be ordered: a duplicate, a missing input, a circle, or a chain too deep."""


@dataclass(frozen=True)
class Signal:
    """compute: (facts, config, outputs of inputs) -> one-row DataFrame with a score; lazily, so pruning costs nothing."""

    id: str
    category: str
    tier: float
    kind: str
    compute: Callable[[dict[str, DataFrame], dict[str, Any], dict[str, DataFrame]], DataFrame]
    inputs: tuple[str, ...] = ()
    optional: tuple[str, ...] = ()
    aliases: tuple[str, ...] = ()
    provider: bool = False
    defaults: dict[str, Any] = field(default_factory=dict)
    evidence: str = "statistical"
    needs: tuple[str, ...] = ()

    @property
    def confidence(self) -> float:
        return TIER_CONFIDENCE.get(self.tier, 0.5)

    @property
    def gates(self) -> bool:
        """Whether a block of this signal may fail the gate: structural, of tier 1 or 2, on evidence that doesn't guess."""
        return self.kind == "structural" and self.tier in (1.0, 2.0) and self.evidence in ("deterministic-ast", "manifest-fact", "reference-backed")

    @property
    def poisons(self) -> bool:
        return self.gates and self.tier <= 1.5 and self.evidence != "reference-backed"


@dataclass(frozen=True)
class Batch:
    """An output that is one row of a frame which several signals share: frame() has (signal_id, score)."""

    name: str
    frame: Callable[[], DataFrame]
    signal: str


@dataclass(frozen=True)
class Failed:
    """What a signal that couldn't be planned leaves behind."""

    why: str


class Registry:
    def __init__(self, signals: Iterable[Signal]):
        self.by_id: dict[str, Signal] = {}
        self.alias: dict[str, str] = {}
        for s in signals:
            for name in (s.id, *s.aliases):
                if name in self.alias:
                    raise RegistryError(f"duplicate id or alias: {name}")
                self.alias[name] = s.id
            self.by_id[s.id] = s
        self.order = self._sorted()

    def resolve(self, name: str) -> Signal:
        if name not in self.alias:
            raise RegistryError(f"unknown signal: {name}")
        return self.by_id[self.alias[name]]

    def _inputs(self, s: Signal) -> list[str]:
        found = []
        for name in s.inputs + s.optional:
            if name in self.alias:
                found.append(self.alias[name])
            elif name in s.inputs:
                raise RegistryError(f"{s.id} needs {name}, which isn't registered")
        return found

    def _sorted(self) -> list[str]:
        """Ids with inputs first; among those that are ready, in the order of registration."""
        needs = {i: set(self._inputs(s)) for i, s in self.by_id.items()}
        depth: dict[str, int] = {}
        order: list[str] = []
        while len(order) < len(needs):
            ready = [i for i in needs if i not in depth and all(n in depth for n in needs[i])]
            if not ready:
                raise RegistryError(f"circle among {sorted(set(needs) - set(depth))}")
            for i in ready:
                depth[i] = 1 + max((depth[n] for n in needs[i]), default=-1)
                if depth[i] > MAX_DEPTH:
                    raise RegistryError(f"{i} is {depth[i]} levels deep; at most {MAX_DEPTH}")
                order.append(i)
        return order

    def ancestors(self, name: str) -> list[str]:
        """The signal and all it needs, in order."""
        wanted, todo = set(), [self.resolve(name).id]
        while todo:
            if (i := todo.pop()) not in wanted:
                wanted.add(i)
                todo += self._inputs(self.by_id[i])
        return [i for i in self.order if i in wanted]


@dataclass
class Vector:
    """What a user sets: active, weight (0 to 2) and config of signals, by id or alias."""

    active: dict[str, bool] = field(default_factory=dict)
    weight: dict[str, float] = field(default_factory=dict)
    config: dict[str, dict[str, Any]] = field(default_factory=dict)

    def checked(self, registry: Registry) -> Vector:
        own = lambda m: {registry.resolve(k).id: v for k, v in m.items()}
        out = Vector(own(self.active), own(self.weight), own(self.config))
        for i, w in out.weight.items():
            if not 0 <= w <= 2:
                raise RegistryError(f"weight of {i} is {w}; it must be from 0 to 2")
        for i, c in out.config.items():
            if unknown := set(c) - set(registry.by_id[i].defaults):
                raise RegistryError(f"{i} has no setting {sorted(unknown)}")
        return out

    def fingerprint(self) -> str:
        return sha256(json.dumps([self.active, self.weight, self.config], sort_keys=True).encode()).hexdigest()


#: Presets, each what it weighs and sets.
PRESETS: dict[str, Vector] = {
    "ai-slop-defense": Vector(
        weight={"TS-SL-01": 1.7, "TS-SL-02": 1.55, "TS-SL-03": 1.5, "TS-SL-04": 1.7, "TS-LD-01": 1.4, "TS-AB-03": 1.3, "TS-AB-05": 1.35, "TS-RP-01": 1.2, "SHARED-03": 1.15},
        config={"TS-SL-01": {"min_tokens": 8}, "TS-SL-02": {"max_groups_analyzed": 8}, "TS-SL-04": {"hard_gate_production": True}, "TS-LD-01": {"max_complexity": 15}, "TS-RP-01": {"min_churn": 1, "min_complexity": 4, "threshold_softness": 0.35}},
    ),
    "domain-purist": Vector(weight={"TS-LD-05": 1.6, "TS-LD-04": 1.2, "TS-AD-01": 1.5, "TS-AD-02": 1.4, "TS-AD-03": 1.2, "TS-AB-01": 1.1, "TS-DE-03": 1.1, "TS-RP-02": 0.8}),
    "refactor-friendly": Vector(
        weight={"TS-RP-01": 1.5, "TS-RP-02": 1.1, "TS-AB-01": 1.3, "TS-AB-02": 1.1, "TS-AD-02": 1.35, "TS-AD-03": 1.2, "TS-DE-01": 1.15, "TS-DE-03": 1.15, "TS-LD-01": 1.1, "SHARED-02": 1.1, "SHARED-03": 1.2}
    ),
    "security-paranoid": Vector(weight={"TS-SL-03": 1.7, "TS-SL-04": 1.65, "TS-DE-05": 1.45, "TS-DE-04": 1.25, "TS-AD-01": 1.1, "TS-AD-02": 1.15, "TS-RP-02": 0.75}),
    "strict-type-safety": Vector(weight={"TS-LD-06": 1.45, "TS-AB-03": 1.3, "TS-AB-05": 1.35, "TS-DE-01": 1.2, "TS-AD-01": 1.1, "TS-AD-02": 1.05, "TS-RP-01": 0.8, "TS-RP-02": 0.7}),
    "velocity-first": Vector(
        weight={"TS-LD-01": 0.45, "TS-LD-02": 0.45, "TS-LD-03": 0.4, "TS-LD-04": 0.45, "TS-LD-05": 0.5, "TS-LD-06": 0.45, "TS-AD-01": 0.55, "TS-AD-02": 0.55, "TS-AD-03": 0.5, "TS-DE-01": 0.5, "TS-DE-02": 0.45, "TS-DE-03": 0.45,
                "TS-DE-04": 1.6, "TS-DE-05": 0.65, "TS-AB-01": 0.45, "TS-AB-02": 0.45, "TS-AB-03": 0.4, "TS-AB-04": 0.45, "TS-AB-05": 0.4, "TS-RP-01": 0.55, "TS-RP-02": 0.55, "TS-SL-01": 0.55, "TS-SL-02": 0.55, "TS-SL-03": 0.65, "TS-SL-04": 0.7}
    ),
}


def ledger(registry: Registry, vector: Vector, patches: dict[str, dict[str, Any]] | None = None) -> list[tuple[str, str, Any, Any, str]]:
    """(signal, setting, default, value, source) of every setting: a module's patch wins over the default, the vector over both."""
    v, patches = vector.checked(registry), {registry.resolve(k).id: p for k, p in (patches or {}).items()}
    out = []
    for i in registry.order:
        for name, default in registry.by_id[i].defaults.items():
            value, source = default, "signal-default"
            for origin, given in (("module", patches.get(i, {})), ("vector", v.config.get(i, {}))):
                if name in given:
                    value, source = given[name], origin
            out.append((i, f"config.{name}", default, value, source))
    return out


def run(registry: Registry, facts: dict[str, DataFrame], vector: Vector | None = None, only: str | None = None) -> dict[str, DataFrame | Batch | Failed]:
    """Outputs of active signals (or of one and what it needs), each a lazy plan; those without their facts are left out.

    A signal that can't be planned is Failed and stops no other; what needs it is left out."""
    v = (vector or Vector()).checked(registry)
    outputs: dict[str, DataFrame | Batch | Failed] = {}
    for i in registry.ancestors(only) if only else registry.order:
        s = registry.by_id[i]
        if not (only or v.active.get(i, True)) or not all(n in facts for n in s.needs):
            continue
        given = {n: outputs[registry.alias[n]] for n in s.inputs + s.optional if isinstance(outputs.get(registry.alias.get(n)), DataFrame)}
        if all(n in given for n in s.inputs):
            try:
                outputs[i] = s.compute(facts, s.defaults | v.config.get(i, {}), given)
            except Exception as why:  # noqa: BLE001  one signal's fault is a finding, not the end of the observation
                outputs[i] = Failed(str(why))
    return outputs


_RESULT = "category string, signal_id string, score double, tier double, weight double, confidence double, grp string, applicability string, authority boolean, provider boolean"


def results(registry: Registry, outputs: dict[str, DataFrame | Batch | Failed], vector: Vector | None = None) -> DataFrame:
    """One row for each output, ready for the observer: of its column `score`; a null score is insufficient evidence, a
    failed signal scores 0 and doesn't count. Signals of one batch are one join of its frame.

    Signals are scored here, one after the other, and their rows written: what reads the results, however often, reads
    those few rows, and no plan holds more than one signal."""
    v = (vector or Vector()).checked(registry)

    def about(i: str) -> tuple:
        s = registry.by_id[i]
        grp = "typescript" if i.startswith("TS-") else "rust" if i.startswith("RS-") else "shared"
        return s.category, i, s.tier, float(v.weight.get(i, 1.0)), s.confidence, grp, s.poisons, s.provider

    columns = ["category", "signal_id", "tier", "weight", "confidence", "grp", "authority", "provider"]
    state = F.when(F.col("score").isNull(), "insufficient_evidence").otherwise("applicable")

    def shaped(scored: DataFrame) -> DataFrame:
        told = F.col("applicability") if "applicability" in scored.columns else state
        return scored.withColumn("applicability", told).withColumn("score", F.coalesce(F.col("score").cast("double"), F.lit(1.0))).select(*(c.split()[0] for c in _RESULT.split(", ")))

    rows, batches, failed = [], {}, []
    for i, out in outputs.items():
        if isinstance(out, Batch):
            batches.setdefault(out.name, (out.frame, []))[1].append((out.signal, *about(i)))
        elif isinstance(out, Failed):
            failed.append(i)
        else:
            if registry.by_id[i].provider:
                continue
            values = {c: F.lit(x) for c, x in zip(columns, about(i), strict=True)}
            keep = [c for c in ("score", "applicability") if c in out.columns]
            rows.append(materialised(shaped(out.select(*keep).withColumns(values)), "score"))
    for frame, members in batches.values():
        scored = frame().select(F.col("signal_id").alias("__s"), "score")
        known = scored.sparkSession.createDataFrame(members, "__s string, " + ", ".join(f"{c} {'double' if c in ('tier', 'weight', 'confidence') else 'boolean' if c in ('authority', 'provider') else 'string'}" for c in columns))
        rows.append(materialised(shaped(F.broadcast(known).join(scored, "__s")), "score"))
    if failed:
        spark = next(x for x in (rows[0] if rows else None,) if x is not None).sparkSession
        rows.append(spark.createDataFrame([(c, i, 0.0, t, w, k, g, "failed", a, p) for c, i, t, w, k, g, a, p in map(about, failed)], _RESULT))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return materialised(out.coalesce(1), "results")


def plugins(names: Iterable[str]) -> list[Signal]:
    """Signals of installed modules: each has a list SIGNALS."""
    return [s for n in names for s in importlib.import_module(n).SIGNALS]


def processed(policies: DataFrame, processors: list[tuple[str, Callable[[DataFrame], DataFrame]]]) -> DataFrame:
    """Policies (key, value) through ordered processors; `decisions` lists who changed what."""
    out = policies.withColumn("decisions", F.array().cast("array<string>"))
    for name, f in processors:
        after = f(out).withColumnRenamed("value", "__v").select("key", "__v")
        out = out.join(after, "key", "left").withColumn("decisions", F.when(F.col("__v").isNotNull() & ~F.col("__v").eqNullSafe(F.col("value")), F.array_append("decisions", F.lit(name))).otherwise(F.col("decisions"))).withColumn("value", F.coalesce("__v", "value")).drop("__v")
    return out
