"""Constants of ranking and index building, all in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class RankConfig:
    """What the score is made of; the defaults are the engine's documented behaviour."""

    important_weight: float = 0.5
    near_step: float = 0.3
    near_all: float = 0.5
    near_slack: int = 5
    gram_weight: float = 0.3
    anchor_weight: float = 1.5
    pagerank_weight: float = 2.5
    authority_weight: float = 1.5
    #: "cf": a gram's rarity comes from its occurrences; "df": from the documents that hold it.
    gram_stat: str = "cf"
    #: Documents below ``demote_below`` times their duplicate class's best score are multiplied by ``demote_factor``.
    demote_near_dups: bool = False
    demote_below: float = 0.9
    demote_factor: float = 0.1
    #: Digits to which scores are rounded before ties are broken.
    digits: int = 9
    top_k: int = 10


@dataclass(frozen=True)
class BuildConfig:
    """How an index is built."""

    #: "stem": Porter stems; "simple": lower-cased words.
    analyzer: str = "stem"
    #: "asof": a link finds the latest earlier page of its URL; "corpus": the latest page of all.
    resolve: str = "asof"
    near_radius: int = 3
    damping: float = 0.85
    max_iterations: int = 100
    tolerance: float = 1e-6
