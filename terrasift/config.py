"""Settings of a run, and the small rules that turn place names and ids into keys."""

from __future__ import annotations

import copy
import re
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml

#: The components of the land value score, in order.
COMPONENTS = ("access_cbd", "access_major_road", "establishment_access", "poi_density", "road_density")

#: The settings that hold where a run sets none.
DEFAULTS: dict[str, Any] = {
    "city": {"place": "Cebu City, Philippines", "osm_id": None, "osm_id_fallbacks": {}, "place_aliases": {}, "study_buffer_km": 12.0},
    "grid": {"edge_km": 0.461, "resolution": 8},
    "cbd": {"lat": None, "lng": None},
    "poi_categories": {
        "mall": {"tags": {"shop": ["mall", "department_store", "supermarket"]}, "weight": 1.0},
        "office": {"tags": {"office": True, "building": ["office", "commercial"]}, "weight": 0.9},
        "transport": {"tags": {"public_transport": ["station"], "amenity": ["bus_station", "ferry_terminal"]}, "weight": 0.8},
        "school": {"tags": {"amenity": ["school", "university", "college"]}, "weight": 0.5},
        "hospital": {"tags": {"amenity": ["hospital", "clinic"]}, "weight": 0.5},
        "government": {"tags": {"amenity": ["townhall", "courthouse"], "office": ["government"]}, "weight": 0.6},
        "bank": {"tags": {"amenity": ["bank"]}, "weight": 0.4},
        "leisure": {"tags": {"leisure": ["park"], "tourism": ["hotel", "attraction"]}, "weight": 0.3},
    },
    "roads": {"major_classes": ["motorway", "trunk", "primary", "secondary"]},
    "water": {"require_reachable": True},
    "landvalue": {
        "decay_scale_km": {"cbd": 3.0, "major_road": 0.6, "establishment": 1.5},
        "weights": {"access_cbd": 0.35, "access_major_road": 0.15, "establishment_access": 0.30, "poi_density": 0.10, "road_density": 0.10},
    },
    "weight_model": {
        "minimum_labels": 6,
        "prior_weights": {"access_cbd": 0.15, "access_major_road": 0.30, "establishment_access": 0.25, "poi_density": 0.20, "road_density": 0.10},
        "minimum_weights": {"access_cbd": 0.10, "access_major_road": 0.25, "establishment_access": 0.20, "poi_density": 0.15, "road_density": 0.05},
        "regularization_grid": [0.3, 1.0, 3.0, 10.0, 30.0, 100.0],
    },
    "price_model": {
        "minimum_market_observations": 15,
        "minimum_market_cities": 10,
        "minimum_labels": 60,
        "minimum_cities": 3,
        "min_price_per_sqm_php": 250.0,
        "max_price_per_sqm_php": 1_000_000.0,
        "land_type_terms": ["land", "lot"],
        "required_property_type_terms": ["commercial"],
        "improvement_terms": ["house", "condo", "townhouse", "building", "improvement"],
        "relative_score_blend": 1.0,
        "minimum_top_anchor_observations": 3,
        "comparable_city_fallback": {
            "n_neighbors": 3, "similarity_bandwidth_log": 0.75, "deposit_ratio_exponent": 1.0, "deposit_ratio_min": 0.01,
            "deposit_ratio_max": 100.0, "interval_min_log": 0.25, "interval_max_log": 0.65,
        },
        "top_anchor_score_quantile": 0.90,
        "relative_score_elasticity": 0.65,
        "relative_multiplier_min": 0.10,
        "relative_multiplier_max": 1.35,
        "anchor_interval_z": 1.2816,
        "anchor_interval_min_log": 0.12,
        "anchor_interval_max_log": 0.35,
    },
    "metro": {
        "min_poi_per_cell": 3.0, "min_road_km_per_cell": 4.0, "min_establishment_access_for_road_cell": 3.0, "bridge_gap": 2, "connector_gap": 2,
        "connector_min_component_cells": 12, "connector_min_road_km_per_cell": 2.0, "connector_min_establishment_access": 3.0,
        "builtup_weights": {"poi_density": 0.5, "road_density": 0.5},
    },
    "economics": {"place_aliases": {}},
}


def _merged(base: dict, changes: dict) -> dict:
    out = copy.deepcopy(base)
    for key, value in changes.items():
        out[key] = _merged(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else copy.deepcopy(value)
    return out


@dataclass(frozen=True)
class Config:
    """Nested settings; config["metro"]["bridge_gap"] or config.metro["bridge_gap"]."""

    values: dict[str, Any] = field(default_factory=lambda: copy.deepcopy(DEFAULTS))

    def __getitem__(self, key: str) -> Any:
        return self.values[key]

    def __getattr__(self, key: str) -> Any:
        try:
            return self.__dict__["values"][key]
        except KeyError:
            raise AttributeError(key) from None

    def with_overrides(self, changes: dict | None) -> Config:
        """This object where nothing changes, else a copy with nested values replaced."""
        return Config(_merged(self.values, changes)) if changes else self

    @property
    def slug(self) -> str:
        return city_slug(self.city["place"])

    @property
    def cache_slug(self) -> str:
        osm_id = self.city.get("osm_id")
        return f"{self.slug}_{normalise_osm_id(osm_id).lower()}" if osm_id else self.slug


def load_config(path: str | Path | None = None) -> Config:
    """The defaults, with a YAML file's values over them."""
    changes = yaml.safe_load(Path(path).read_text()) if path else None
    return Config().with_overrides(changes)


def city_slug(place: str) -> str:
    return place.split(",")[0].strip().lower().replace(" ", "_")


def normalise_osm_id(value: str) -> str:
    """N, W or R and digits, from a URL, "relation 123", "R123" or bare digits (a relation)."""
    text = str(value).strip()
    found = re.search(r"(node|way|relation)[\s/:]*(\d+)", text, re.IGNORECASE)
    if found:
        return found[1][0].upper() + found[2]
    found = re.fullmatch(r"([NWRnwr]?)\s*(\d+)", text)
    if not found:
        raise ValueError(f"not an OSM id: {value!r}")
    return (found[1] or "R").upper() + found[2]


def norm_place(place: str) -> str:
    return " ".join(place.lower().replace(",", " ").split())


def fallback_osm_id(config: Config, place: str) -> str | None:
    """The id configured for a place, or for a name that the place begins with."""
    own = norm_place(place)
    for key, osm_id in (config.city.get("osm_id_fallbacks") or {}).items():
        name = norm_place(str(key))
        if own == name or own.startswith(f"{name} "):
            return str(osm_id)
    return None


def resolved_place(config: Config, place: str) -> str:
    own = norm_place(place)
    return next((str(v) for k, v in (config.city.get("place_aliases") or {}).items() if norm_place(str(k)) == own), place)


def normalised_weights(weights: dict[str, float]) -> dict[str, float]:
    """Component weights that sum to 1: negatives count as 0, all 0 as equal."""
    clipped = {c: max(float(weights.get(c, 0) or 0), 0.0) for c in COMPONENTS}
    total = sum(clipped.values())
    return {c: w / total if total > 0 else 1 / len(COMPONENTS) for c, w in clipped.items()}


def combined_tags(config: Config) -> dict[str, Any]:
    """One tag request for all categories: True (any value) wins over lists, lists join in order."""
    out: dict[str, Any] = {}
    for category in config.poi_categories.values():
        for key, wanted in category["tags"].items():
            if wanted is True or out.get(key) is True:
                out[key] = True
            else:
                values = wanted if isinstance(wanted, list) else [wanted]
                out[key] = [*out.get(key, []), *(v for v in values if v not in out.get(key, []))]
    return out
