"""Tunable parameters, passed explicitly to the operators that need them."""

from __future__ import annotations

from dataclasses import dataclass

SECOND = 1_000_000  # the capture clock counts microseconds


@dataclass(frozen=True)
class Params:
    # flow assembly
    idle_s: float = 15.0
    syn_s: float = 3.0
    active_s: float = 120.0
    # behavioural windows
    short_s: int = 10
    long_s: int = 60
    # detection
    base_threshold: float = 0.98
    min_threshold: float = 0.97
    max_threshold: float = 0.995
    host_quantile: float = 0.99
    min_samples: int = 60
    score_memory: int = 512
    recompute_every: int = 16
    forget_s: int = 7 * 86_400    # streams forget a host that was silent for so long
    unknown_below: float = 0.55
    veto_confidence: float = 0.90
    override_score: float = 0.9975
    # correlation
    dedup_s: int = 60
    alerts_per_incident: int | None = None  # a number caps what is stored of each incident
    # explanation
    explain_top: int = 4
    explain_per_batch: int = 6
    class_cap: int = 2500
    # Physical layout. They change the plan, never the result.
    slice_s: int = 600            # width of the time slices a busy key is cut into
    dimension_rows: int = 100_000  # dimensions up to this size are broadcast
    group_rows: int = 2_000_000   # larger groups are folded in slices

    def __post_init__(self) -> None:
        if not self.min_threshold <= self.base_threshold <= self.max_threshold:
            raise ValueError("thresholds must satisfy min <= base <= max")
        if self.slice_s * SECOND <= 0 or self.short_s > self.long_s:
            raise ValueError("window spans must be positive and ordered")

    @property
    def idle_us(self) -> int:
        return int(self.idle_s * SECOND)

    @property
    def syn_us(self) -> int:
        return int(self.syn_s * SECOND)

    @property
    def active_us(self) -> int:
        return int(self.active_s * SECOND)
