"""Settings: an immutable value, merged from layers; a later layer wins, key by key."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

FILE_NAME = "waymesh.json"
ENVIRONMENT = "WAYMESH_CONFIG"

#: The zoom from which a class is drawn. Classes not listed are always drawn.
MIN_ZOOM = {
    "motorway": 4, "motorway_link": 11, "trunk": 5, "trunk_link": 11, "primary": 7, "primary_link": 11, "secondary": 9, "secondary_link": 12,
    "tertiary": 11, "tertiary_link": 12, "residential": 13, "unclassified": 13, "living_street": 14, "service": 15, "track": 14, "cycleway": 14,
    "footway": 15, "path": 15, "pedestrian": 14,
}


#: The defaults.
@dataclass(frozen=True)
class Settings:
    fill_opacity: float = 0.9
    casing_opacity: float = 0.75
    link_scale: float = 0.7
    tunnel_scale: float = 0.45
    tunnel_dash: tuple[int, int] = (4, 4)
    bridge_casing: str = "#000000"
    bridge_extra: float = 1.5
    basemap: str = "voyager"
    slot_m: float = 100.0
    min_zoom: Mapping[str, int] = field(default_factory=lambda: dict(MIN_ZOOM))
    tiles: Mapping[str, int] = field(default_factory=lambda: {"minzoom": 6, "maxzoom": 15, "extent": 4096, "buffer_px": 80})
    selection: Mapping[str, float] = field(default_factory=lambda: {"halo": 3.0, "ring": 1.8, "core": 1.5})
    decks: Mapping[str, float] = field(
        default_factory=lambda: {"base_m": 5.0, "thickness_m": 1.0, "ramp_m": 40.0, "step_m": 2.5, "match_zoom": 18.0, "opacity": 0.7, "width_scale": 0.6, "flat_below": 16.0, "casing_px": 2.0}
    )


DEFAULT = Settings()


def deep_merge(base: Mapping, over: Mapping) -> dict:
    """Both, nested mappings merged in turn; over wins."""
    out = dict(base)
    for k, v in over.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def merged(settings: Settings, over: Mapping) -> Settings:
    """settings with over merged in. Unknown keys are an error."""
    unknown = set(over) - {f.name for f in fields(settings)}
    if unknown:
        raise ValueError(f"unknown settings {sorted(unknown)}")
    new = {k: deep_merge(getattr(settings, k), v) if isinstance(v, Mapping) else tuple(v) if isinstance(v, list) else v for k, v in over.items()}
    return replace(settings, **new)


def layers(home: Path | None = None, cwd: Path | None = None, environment: Mapping[str, str] | None = None) -> list[dict]:
    """The files that there are, weakest first: the user's, the folder's, the one that the environment names. Unreadable
    and malformed files are passed over."""
    environment = os.environ if environment is None else environment
    base = Path(environment.get("XDG_CONFIG_HOME") or (home or Path.home()) / ".config")
    places = [base / "waymesh" / FILE_NAME, (cwd or Path.cwd()) / FILE_NAME]
    if named := environment.get(ENVIRONMENT):
        places.append(Path(named))
    out = []
    for p in places:
        try:
            found = json.loads(p.read_text())
        except (OSError, ValueError):
            continue
        if isinstance(found, dict):
            out.append(found)
    return out


def resolve(call: Mapping | None = None, program: Mapping | None = None, **where) -> Settings:
    """Defaults, then files, then the program's settings, then those of the call."""
    settings = DEFAULT
    for layer in (*layers(**where), program or {}, call or {}):
        settings = merged(settings, layer)
    return settings
