"""Base maps: where their tiles are. Data only; nothing is fetched."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class BaseMap:
    key: str
    label: str
    url: str
    attribution: str = ""
    is_dark: bool = False
    satellite: bool = False
    subdomains: str = "abc"
    background: str = "#ffffff"


_CARTO = "OpenStreetMap contributors, CARTO"
_CARTO_URL = "https://{s}.basemaps.cartocdn.com/%s/{z}/{x}/{y}{r}.png"
_ARCGIS_URL = "https://server.arcgisonline.com/ArcGIS/rest/services/%s/MapServer/tile/{z}/{y}/{x}"

#: Keys and tile services. A base map without a url is a plain background, and needs no network.
BASEMAPS = {
    m.key: m
    for m in (
        BaseMap("voyager", "Voyager", _CARTO_URL % "rastertiles/voyager", _CARTO, subdomains="abcd", background="#dfe7ea"),
        BaseMap("positron", "Positron", _CARTO_URL % "light_all", _CARTO, subdomains="abcd", background="#ebeff2"),
        BaseMap("dark_matter", "Dark Matter", _CARTO_URL % "dark_all", _CARTO, True, subdomains="abcd", background="#111111"),
        BaseMap("osm", "OpenStreetMap", "https://{s}.tile.openstreetmap.org/{z}/{x}/{y}.png", "OpenStreetMap contributors", background="#ede9e2"),
        BaseMap("esri_gray", "Light Gray", _ARCGIS_URL % "Canvas/World_Light_Gray_Base", "Esri", subdomains="", background="#e2e6e9"),
        BaseMap("satellite", "Satellite", _ARCGIS_URL % "World_Imagery", "Esri", True, True, subdomains="", background="#2d3823"),
        BaseMap("blank", "Blank", "", subdomains="", background="#efede8"),
        BaseMap("blank_dark", "Blank dark", "", "", True, subdomains="", background="#14181d"),
    )
}
DEFAULT_BASEMAP = "voyager"
SWITCHER = ("voyager", "positron", "dark_matter", "osm", "satellite", "blank")  # offered where a caller names none


def register_basemap(m: BaseMap) -> None:
    if not isinstance(m, BaseMap):
        raise TypeError(f"a BaseMap is expected, not {type(m).__name__}")
    BASEMAPS[m.key] = m


def get_basemap(key) -> BaseMap:
    """By key, or from an object that describes tiles (attributes or keys name, url, attribution, subdomains)."""
    if isinstance(key, BaseMap):
        return key
    if isinstance(key, str):
        if key not in BASEMAPS:
            raise ValueError(f"unknown base map {key!r}; choose from {sorted(BASEMAPS)}")
        return BASEMAPS[key]
    get = key.get if hasattr(key, "get") else lambda k, d=None: getattr(key, k, d)
    build = getattr(key, "build_url", None)  # an object that fills in its own variant and access key
    url = (build() if callable(build) else None) or get("url")
    if not url:
        raise ValueError("a base map needs a url")
    name = str(get("name") or "custom")
    return BaseMap(name, name.replace("_", " "), str(url), str(get("attribution") or get("html_attribution") or ""), "dark" in name.lower(), subdomains=str(get("subdomains") or "abc"))


def tile_urls(m: BaseMap) -> list[str]:
    """One template for each subdomain; tiles of plain resolution."""
    url = m.url.replace("{r}", "")
    return [url.replace("{s}", s) for s in m.subdomains] if "{s}" in url and m.subdomains else [url] if url else []
