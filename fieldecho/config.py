"""Site configuration, passed explicitly to every job that needs it."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

ENV_VAR = "FIELDECHO_CONFIG"
FILE_NAME = "fieldecho.toml"


@dataclass(frozen=True)
class Thresholds:
    # Defaults that decide which events are selected.
    concordance_probs: tuple[float, ...] = (0.9, 0.75, 0.5)
    min_active_recorders: int = 4
    flexible_min_max_prob: float = 0.9
    flexible_min_concordant_recs: int = 3
    flexible_max_per_species: int | None = None  # no cut unless asked for
    strict_agreement_fraction: float = 1.0
    strict_min_prob: float = 0.9


@dataclass(frozen=True)
class SiteConfig:
    timezone: str
    lat: float
    lon: float
    topdirs: tuple[str, ...]
    name: str = ""
    sample_rate: int = 44100
    catalog: str = "wavfiles.parquet"
    recorder_zones: str = "regions/recorder_zones.json"
    checkpoint_dir: str = "checkpoints"
    site_species: str | None = None
    model_path: str | None = None
    labels_path: str | None = None
    thresholds: Thresholds = field(default_factory=Thresholds)


def find_config(explicit: str | None = None) -> Path:
    """Explicit path, then the environment variable, the working directory, the home directory."""
    named = explicit or os.environ.get(ENV_VAR)
    if named:
        if not Path(named).exists():
            raise FileNotFoundError(f"config file not found: {named}")
        return Path(named)
    for folder in (Path.cwd(), Path.home()):
        if (folder / FILE_NAME).exists():
            return folder / FILE_NAME
    raise FileNotFoundError(f"no {FILE_NAME}; set {ENV_VAR} or pass a path")


def load_config(path: str | None = None) -> SiteConfig:
    raw = tomllib.loads(find_config(path).read_text())
    site, audio = raw.get("site", {}), raw.get("audio", {})
    for section, key, src in (("site", "timezone", site), ("site", "lat", site),
                              ("site", "lon", site), ("audio", "topdirs", audio)):
        if src.get(key) is None:
            raise KeyError(f"missing required key [{section}].{key}")
    paths, model = raw.get("paths", {}), raw.get("classifier", {})
    th = dict(raw.get("thresholds", {}))
    if "concordance_probs" in th:
        th["concordance_probs"] = tuple(sorted(map(float, th["concordance_probs"]), reverse=True))
    return SiteConfig(
        timezone=site["timezone"], lat=float(site["lat"]), lon=float(site["lon"]),
        topdirs=tuple(audio["topdirs"]), name=site.get("name", ""),
        sample_rate=int(audio.get("sample_rate", SiteConfig.sample_rate)),
        catalog=paths.get("catalog", SiteConfig.catalog),
        recorder_zones=paths.get("recorder_zones", SiteConfig.recorder_zones),
        checkpoint_dir=paths.get("checkpoint_dir", SiteConfig.checkpoint_dir),
        site_species=paths.get("site_species") or None,
        model_path=model.get("model_path") or None,
        labels_path=model.get("labels_path") or None,
        thresholds=Thresholds(**th))
