"""Tunable settings. The defaults are fixed values that define the semantics."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

SECOND = 1000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
DAY = 24 * HOUR


@dataclass(frozen=True)
class UrlOptions:
    schema_version: int = 2
    canonical_path_depth: int = 2
    allowed_query_keys: tuple[str, ...] = (
        "filter",
        "mode",
        "page",
        "section",
        "sort",
        "status",
        "tab",
        "type",
        "view",
    )


@dataclass(frozen=True)
class SessionOptions:
    """Session cutting. ``slice_ms`` is physical only: it never changes results."""

    inactivity_ms: int = 150 * SECOND
    context_shift_ms: int = 75 * SECOND
    interruption_reset_ms: int = 60 * SECOND
    significant_context_score: int = 2
    rolling_window_ms: int = 5 * MINUTE
    rolling_minimum_gap_ms: int = 45 * SECOND
    rolling_minimum_events: int = 3
    rolling_dominance: float = 0.6
    slice_ms: int = HOUR


@dataclass(frozen=True)
class LabelOptions:
    nearby_ms: int = 45 * SECOND
    slice_ms: int = HOUR


@dataclass(frozen=True)
class SimilarityWeights:
    sequence: float = 0.35
    action_set: float = 0.25
    context: float = 0.25
    time_of_day: float = 0.15

    def normalized(self) -> "SimilarityWeights":
        total = self.sequence + self.action_set + self.context + self.time_of_day
        if total <= 0:
            return SimilarityWeights()
        return SimilarityWeights(
            self.sequence / total,
            self.action_set / total,
            self.context / total,
            self.time_of_day / total,
        )


@dataclass(frozen=True)
class ConfidenceWeights:
    composite: float = 0.55
    top_variant: float = 0.25
    repetition: float = 0.2

    def normalized(self) -> "ConfidenceWeights":
        total = self.composite + self.top_variant + self.repetition
        if total <= 0:
            return ConfidenceWeights()
        return ConfidenceWeights(
            self.composite / total, self.top_variant / total, self.repetition / total
        )


@dataclass(frozen=True)
class ClusterOptions:
    detection_mode: str = "standard"
    similarity_threshold: float = 0.74
    min_duration_seconds: float = 45
    max_duration_seconds: float | None = None
    max_actions: int | None = None
    min_frequency: int = 3
    confirmation_days: int = 7
    strategy: str = "hybrid_v2"
    similarity_weights: SimilarityWeights = field(default_factory=SimilarityWeights)
    confidence_weights: ConfidenceWeights = field(default_factory=ConfidenceWeights)


@dataclass(frozen=True)
class ShortFormOptions:
    max_duration_seconds: float = 20
    max_actions: int = 3
    similarity_threshold: float = 0.86
    min_meaningful: int = 1
    min_frequency: int = 3


@dataclass(frozen=True)
class AnalyzeOptions:
    urls: UrlOptions = field(default_factory=UrlOptions)
    labels: LabelOptions = field(default_factory=LabelOptions)
    sessions: SessionOptions = field(default_factory=SessionOptions)
    clusters: ClusterOptions = field(default_factory=ClusterOptions)
    short_form: ShortFormOptions = field(default_factory=ShortFormOptions)

    def stretched(self, factor: int, slice_ms: int = DAY) -> "AnalyzeOptions":
        """The same settings with every duration multiplied, for sparse data."""
        s, c = self.sessions, self.clusters
        return replace(
            self,
            labels=LabelOptions(self.labels.nearby_ms * factor, slice_ms),
            sessions=SessionOptions(
                inactivity_ms=s.inactivity_ms * factor,
                context_shift_ms=s.context_shift_ms * factor,
                interruption_reset_ms=s.interruption_reset_ms * factor,
                significant_context_score=s.significant_context_score,
                rolling_window_ms=s.rolling_window_ms * factor,
                rolling_minimum_gap_ms=s.rolling_minimum_gap_ms * factor,
                rolling_minimum_events=s.rolling_minimum_events,
                rolling_dominance=s.rolling_dominance,
                slice_ms=slice_ms,
            ),
            clusters=replace(c, min_duration_seconds=c.min_duration_seconds * factor),
            short_form=replace(
                self.short_form,
                max_duration_seconds=self.short_form.max_duration_seconds * factor,
            ),
        )
