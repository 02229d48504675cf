"""Settings of the three pipelines."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Monitor:
    """Fixed values of the monitoring round, but for the site lists, which each installation gives itself."""

    pass_rate: float = 0.9
    k_min: int = 20
    c_max: float = 2.0
    budget: int = 2000
    volatility: float = 3.0
    growth: float = 5.0
    eps: float = 1e-6
    fail_threshold: int = 3
    window: int = 5
    keep: int = 10
    #: our own: the stretch of a site's history that one task orders
    period: str = "month"
    ok_status: tuple[int, ...] = (200, 301, 302)
    api_sites: tuple[str, ...] = ("data.quellmar.example",)
    browser_sites: tuple[str, ...] = ("portal.example",)


@dataclass(frozen=True)
class Dedup:
    """Fixed values of record linkage."""

    bits: int = 64
    bands: int = 8
    planes: int = 16
    threshold: float = 0.82
    bucket: int = 500
    sub_buckets: int = 50
    sub_dims: int = 10
    max_features: int = 20_000
    in_bucket: int = 50
    #: our own: rows that meet in a bucket of a table, the share of pairs at the threshold that is to be found, seed of the planes
    met: int = 128
    recall: float = 0.95
    plane_seed: int = 17
    fields: tuple[str, ...] = ("dataset_name", "dataset_desc", "dataset_url", "source")


@dataclass(frozen=True)
class Tagging:
    """Tagging settings; the values of those that nobody published are our own."""

    alpha: float = 1.0
    beta: float = 1.0
    min_frequency: int = 2
    max_terms: int = 20
    max_phrases: int = 20
    synonym: float = 0.9
    edge: float = 0.1
    gamma: float = 0.5
    seeds: int = 5
    mmr: float = 0.5
    iterations: int = 10
    restart: float = 0.15
    top: int = 10
    chosen: int = 2
    seed_size: int = 1000
    prompt_chars: int = 500


MONITOR, DEDUP, TAGGING = Monitor(), Dedup(), Tagging()
