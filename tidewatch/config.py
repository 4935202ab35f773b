"""Settings of the analytics engine, with a JSON form."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field
from pathlib import Path


@dataclass(frozen=True)
class Io:
    input_csv: str | None = None
    output_dir: str = "output"
    table_name: str = "Conn_logs"
    query_start: str = "2025-10-22 00:00:00"
    query_end: str = "2025-10-22 23:59:59"
    query_limit: int = 1_000_000


@dataclass(frozen=True)
class Channels:
    min_flows: int = 8
    max_channels: int = 5000
    key: tuple[str, ...] = ("src_ip", "dst_ip", "dst_port", "proto")


@dataclass(frozen=True)
class Prefilter:
    dst_fanin_threshold: float = 0.5
    failed_conn_threshold: float = 0.9
    least_kept: float = 0.05


@dataclass(frozen=True)
class Isolation:
    n_estimators: int = 200
    max_samples: int = 3000
    test_size: float = 0.3
    random_state: int = 42
    contamination: float = 0.05
    stability_threshold: float = 0.8
    small_pool: int = 20


@dataclass(frozen=True)
class Sax:
    word_length: int = 20
    alphabet_size: int = 4
    cv_threshold: float = 0.6
    acf_threshold: float = 0.3
    motif_threshold: float = 0.4
    min_tests_passing: int = 2
    min_observations: int = 8
    max_acf_lag: int = 10


@dataclass(frozen=True)
class Periodicity:
    min_observations: int = 10
    acf_nlags: int = 40
    acf_significance_threshold: float = 0.25
    cv_threshold: float = 0.6
    fft_power_ratio_threshold: float = 0.15
    min_period_s: float = 60.0
    confidence_threshold: float = 0.45


@dataclass(frozen=True)
class Pelt:
    penalty: str | float = "bic"
    min_segment_length: int = 5
    min_observations: int = 15
    prune: str = "exact"


@dataclass(frozen=True)
class Tls:
    sni_entropy_threshold: float = 1.0
    ja3_monotony_threshold: float = 0.9
    cert_reuse_min_sessions: int = 3
    resumption_threshold: float = 0.8
    ja3_known_c2: tuple[str, ...] = ("e7d705a3286e19ea42f587b344ee6865", "6d4e5b73a8e1c8a0f9c6e62f7b2d1a9c")
    h5_weight: float = 0.3
    h6_weight: float = 0.3


@dataclass(frozen=True)
class Corroboration:
    period_tolerance_pct: float = 0.15
    short_ttl_threshold_s: float = 300.0
    dga_entropy_threshold: float = 3.5
    dga_min_label_len: int = 8
    http_body_cv_threshold: float = 0.3
    http_uri_cv_threshold: float = 0.4
    rare_ua_threshold: float = 0.05
    uri_entropy_threshold: float = 4.0
    min_score: float = 0.55
    dns_min_obs_duty_cycle: float = 0.5
    nxdomain_rate_threshold: float = 0.1
    fast_flux_unique_ip_threshold: int = 5
    global_ua_rare_threshold: float = 0.01
    high_entropy_uri_frac: float = 0.25
    extra_benign_domain_suffixes: tuple[str, ...] = ()
    body_cv_trim_pct: float = 0.05
    tls: Tls = field(default_factory=Tls)


@dataclass(frozen=True)
class Triage:
    off_hour_range: tuple[int, int] = (6, 22)


@dataclass(frozen=True)
class Settings:
    """``parity="reference"`` brings back the quirks listed in the README; the default is the documented behaviour."""

    io: Io = field(default_factory=Io)
    channels: Channels = field(default_factory=Channels)
    prefilter: Prefilter = field(default_factory=Prefilter)
    isolation: Isolation = field(default_factory=Isolation)
    sax: Sax = field(default_factory=Sax)
    periodicity: Periodicity = field(default_factory=Periodicity)
    pelt: Pelt = field(default_factory=Pelt)
    corroboration: Corroboration = field(default_factory=Corroboration)
    triage: Triage = field(default_factory=Triage)
    parity: str = "documented"

    def to_json(self, path: str) -> None:
        Path(path).write_text(json.dumps(dataclasses.asdict(self), indent=2))

    @classmethod
    def from_json(cls, path: str) -> Settings:
        return _build(cls, json.loads(Path(path).read_text()))


def _build(cls, values: dict):
    """Unknown names are refused, missing ones keep their defaults, lists become tuples."""
    own = {f.name: f for f in dataclasses.fields(cls)}
    if unknown := set(values) - set(own):
        raise ValueError(f"{cls.__name__} has no {sorted(unknown)}")
    base, out = cls(), {}
    for name, value in values.items():
        now = getattr(base, name)
        out[name] = _build(type(now), value) if dataclasses.is_dataclass(now) else tuple(value) if isinstance(now, tuple) else value
    return cls(**out)
