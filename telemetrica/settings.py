"""Settings of a run: a tree of defaults, files laid over it, and the policies that are built and checked from it."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from pathlib import Path

from telemetrica.config import load_yaml, merged
from telemetrica.functions.folds import InnovationConfig, StepConfig, TrackerConfig
from telemetrica.operators.comms import BudgetConfig
from telemetrica.operators.incidents import PRIORITY, GroupPolicy, IncidentPolicy
from telemetrica.operators.signals import COMPONENTS, SignalConfig

#: Settings and their defaults.
DEFAULTS: dict = {
    "engine": {"scan_interval": 0.1, "auto_register": True, "treat_missing_signals_as_none": True, "unknown_signal_policy": "error", "max_signals_policy": "error"},
    "filters": {"default_ewma_alpha": 0.3, "default_ma_window": 10},
    "drift": {"small_threshold": 0.5, "large_threshold": 5.0, "sustained_window": 10, "monotonic_window": 5},
    "variance": {"default_window": 20, "spike_k_sigma": 3.0, "debounce_samples": 1},
    "innovation": {"enabled": False, "q": 0.01, "r": 1.0, "beta": 0.05, "s_min": 1e-12, "p0_var": 1e6, "v0_var": 1e4, "z_spike": 6.0, "noise_threshold": 1.0},
    "stale": {"window": 5, "recovery_window": 3},
    "step_change": {"baseline_window": 10, "threshold": 5.0, "persistence_scans": 3, "recovery_scans": 5},
    "plausibility": {"default": {"min": None, "max": None, "max_rate": None, "persistence_scans": 1, "recovery_scans": 1}, "by_signal": {}, "by_prefix": {}},
    "frequency": {"reference_frequencies": [], "window_size": 50, "threshold": 0.5},
    "sqi": {
        "weights": {"noise": 0.25, "drift": 0.25, "spikes": 0.20, "oscillation": 0.15, "missing": 0.15, "stale": 0.0, "step": 0.0, "plausibility": 0.0},
        "thresholds": {"noise": 0.1, "drift": 1.0, "spike": 0.05, "oscillation": 0.3},
    },
    "alerts": {"critical_threshold": 25.0, "warning_threshold": 50.0, "drift_alert_threshold": 5.0, "spike_alert_threshold": 0.1},
    "performance": {"max_signals": 1000},
    "incidents": {
        "start_sqi": 50.0, "end_sqi": 60.0, "start_persistence_scans": 5, "end_persistence_scans": 10, "critical_sqi": 25.0, "component_floor": 70.0, "hard_fault_causes": ["missing"], "cause_priority": list(PRIORITY),
    },
    "grouping": {"strategy": "prefix", "delimiter": "_", "depth": 2, "explicit": {}},
    "group_incidents": {"min_members_for_start": 2, "min_fraction_for_start": 0.5, "start_persistence_scans": 2, "end_persistence_scans": 2, "critical_fraction_threshold": 0.8},
    "event_filter": {"suppress_member_events": True, "suppress_group_causes": ["comms"], "suppress_event_types": ["started", "updated"], "allow_resolved_passthrough": True},
    "comms": {"budget": {"scan_interval_ms": 1000.0, "bytes_per_signal_estimate": 18, "protocol_overhead_bytes": 200, "default_capacity_bps_by_type": {"rtu": 9600, "poll_group": 9600, "comms_domain": 9600}, "per_node_capacity_bps": {}}},
    "node_incidents": {"start_confidence": 0.7, "start_score": 0.5, "continue_confidence": 0.3, "continue_score": 0.2, "cooldown_scans": 3},
}


def load_settings(path: str | None = None, changes: dict | None = None) -> dict:
    """The defaults with a YAML file and further changes laid over; unknown and repeated keys are errors."""
    out = merged(DEFAULTS, load_yaml(Path(path).read_text()) if path else {})
    return merged(out, changes or {})


def in_range(name: str, value: float, low: float | None = None, high: float | None = None) -> float:
    if (low is not None and value < low) or (high is not None and value > high):
        raise ValueError(f"{name} is out of range: {value}")
    return value


def plausibility_of(settings: dict, signal_id: str) -> dict:
    """The limits of a signal: defaults, then its own, or else those of ever longer prefixes in the order of the file."""
    rules = settings["plausibility"]
    own = dict(rules["default"])
    if signal_id in rules["by_signal"]:
        return own | rules["by_signal"][signal_id]
    longest = -1
    for prefix, rule in rules["by_prefix"].items():
        if signal_id.startswith(prefix) and len(prefix) > longest:
            own, longest = own | rule, len(prefix)
    return own


def signal_config(settings: dict, signal_id: str | None = None) -> SignalConfig:
    """The configuration of all signals, or of one with its own plausibility limits."""
    f, d, v, i, st = (settings[k] for k in ("filters", "drift", "variance", "innovation", "step_change"))
    limits = plausibility_of(settings, signal_id) if signal_id is not None else settings["plausibility"]["default"]
    q, t, a = settings["frequency"], settings["sqi"]["thresholds"], settings["alerts"]
    return SignalConfig(
        alpha=f["default_ewma_alpha"], ma_window=f["default_ma_window"], drift_small=d["small_threshold"], drift_large=d["large_threshold"], sustained_window=d["sustained_window"],
        monotonic_window=d["monotonic_window"], variance_window=v["default_window"], spike_sigma=v["spike_k_sigma"], spike_debounce=v["debounce_samples"],
        stale_window=settings["stale"]["window"], stale_recovery=settings["stale"]["recovery_window"],
        step=StepConfig(st["baseline_window"], st["threshold"], st["persistence_scans"], st["recovery_scans"]),
        value_min=limits["min"], value_max=limits["max"], max_rate=limits["max_rate"], plausibility_persistence=limits["persistence_scans"], plausibility_recovery=limits["recovery_scans"],
        frequencies=tuple(q["reference_frequencies"]), frequency_window=q["window_size"], frequency_threshold=q["threshold"], sample_interval=settings["engine"]["scan_interval"],
        innovation=InnovationConfig(i["q"], i["r"], i["beta"], i["s_min"], i["p0_var"], i["v0_var"], None, i["z_spike"], settings["engine"]["scan_interval"]), innovation_enabled=i["enabled"],
        weights=tuple(settings["sqi"]["weights"][c] for c in COMPONENTS), noise_threshold=i["noise_threshold"] if i["enabled"] else t["noise"], drift_threshold=t["drift"], spike_threshold=t["spike"],
        oscillation_threshold=t["oscillation"], sqi_critical=a["critical_threshold"], sqi_warning=a["warning_threshold"], drift_alert=a["drift_alert_threshold"], spike_alert=a["spike_alert_threshold"],
    )


def incident_policy(settings: dict) -> IncidentPolicy:
    s = settings["incidents"]
    for name in ("start_sqi", "end_sqi", "critical_sqi", "component_floor"):
        in_range(f"incidents.{name}", s[name], 0, 100)
    for name in ("start_persistence_scans", "end_persistence_scans"):
        in_range(f"incidents.{name}", s[name], 1)
    if s["end_sqi"] < s["start_sqi"]:
        raise ValueError("incidents.end_sqi is below start_sqi")
    if unknown := sorted({*s["hard_fault_causes"], *s["cause_priority"]} - set(PRIORITY)):
        raise ValueError(f"unknown causes: {unknown}")
    return IncidentPolicy(s["start_sqi"], s["end_sqi"], s["start_persistence_scans"], s["end_persistence_scans"], s["critical_sqi"], s["component_floor"], tuple(s["hard_fault_causes"]), tuple(s["cause_priority"]))


def required_causes(policy: IncidentPolicy) -> set[str]:
    """Components that the policy's hard faults need, whatever their weight."""
    return set(policy.hard_faults) & set(COMPONENTS)


def group_policy(settings: dict) -> GroupPolicy:
    g, s = settings["grouping"], settings["group_incidents"]
    in_range("grouping.depth", g["depth"], 1)
    if g["strategy"] not in ("prefix", "explicit"):
        raise ValueError(f"unknown grouping strategy: {g['strategy']}")
    in_range("group_incidents.min_members_for_start", s["min_members_for_start"], 1)
    for name in ("min_fraction_for_start", "critical_fraction_threshold"):
        in_range(f"group_incidents.{name}", s[name], 0, 1)
    for name in ("start_persistence_scans", "end_persistence_scans"):
        in_range(f"group_incidents.{name}", s[name], 1)
    return GroupPolicy(g["delimiter"], g["depth"], s["min_members_for_start"], s["min_fraction_for_start"], s["start_persistence_scans"], s["end_persistence_scans"], s["critical_fraction_threshold"])


def budget_config(settings: dict) -> BudgetConfig:
    b = settings["comms"]["budget"]
    by_type = {k.upper(): v for k, v in b["default_capacity_bps_by_type"].items()}
    return BudgetConfig(b["scan_interval_ms"], b["bytes_per_signal_estimate"], b["protocol_overhead_bytes"], by_type, dict(b["per_node_capacity_bps"]))


def tracker_config(settings: dict) -> TrackerConfig:
    n = settings["node_incidents"]
    return TrackerConfig(n["start_confidence"], n["start_score"], n["continue_confidence"], n["continue_score"], n["cooldown_scans"])


@dataclass(frozen=True)
class Run:
    """Everything that a run needs, built from settings."""

    signal: SignalConfig = field(default_factory=SignalConfig)
    incidents: IncidentPolicy = field(default_factory=IncidentPolicy)
    groups: GroupPolicy | None = None
    explicit_groups: dict[str, str] = field(default_factory=dict)
    budget: BudgetConfig = field(default_factory=BudgetConfig)
    suppress: bool = True
    causes: tuple[str, ...] = ("comms",)
    kinds: tuple[str, ...] = ("started", "updated")
    passed: bool = True
    max_signals: int = 1000
    max_signals_policy: str = "error"
    run_id: str = "run"

    @classmethod
    def of(cls, settings: dict, grouped: bool = False, run_id: str = "run") -> Run:
        f = settings["event_filter"]
        return cls(
            signal_config(settings), incident_policy(settings), group_policy(settings) if grouped else None, explicit_of(settings) if grouped else {}, budget_config(settings),
            f["suppress_member_events"], tuple(f["suppress_group_causes"]), tuple(f["suppress_event_types"]), f["allow_resolved_passthrough"],
            settings["performance"]["max_signals"], settings["engine"]["max_signals_policy"], run_id,
        )

    def with_persistence(self, start: int, end: int) -> Run:
        return replace(self, incidents=replace(self.incidents, start_persistence=start, end_persistence=end))


def explicit_of(settings: dict) -> dict[str, str]:
    """Signal to group for the explicit strategy; the first group that names a signal has it."""
    if settings["grouping"]["strategy"] != "explicit":
        return {}
    out: dict[str, str] = {}
    for group, members in settings["grouping"]["explicit"].items():
        for signal in members:
            out.setdefault(signal, group)
    return out
