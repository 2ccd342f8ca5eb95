"""Tunables of the engine, as one immutable value; functions take it as an argument."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    zero_min_ratings: int = 20
    low_sample: int = 20
    agreement: int = 7
    channel_gap: int = 10
    corpus_min_chars: int = 80
    corpus_max_chars: int = 1500
    stratum_share: float = 0.15
    off_topic_ratio: float = 0.06
    claim_support: int = 3
    small_corpus_support: int = 2
    small_corpus: int = 20
    temporal_days: int = 30
    history: int = 10
    similar_top: int = 12
    similar_candidates: int = 300
    similar_min: float = 0.34
    similar_metadata: float = 0.62
    similar_aspect: float = 0.26
    similar_lexical: float = 0.12
    reason_floor: float = 0.18
    daily_cost: float = 10.0
    hourly_calls: int = 100
    new_reviews: int = 10
    new_ratio: float = 0.2
    score_move: int = 3
    summary_days: int = 90
    critic_threshold: int = 5
    player_threshold: int = 20
    gap_points: int = 7
    video_min_score: float = 60.0
    video_min_seconds: int = 600
    video_max_seconds: int = 25200


DEFAULT = Settings()
