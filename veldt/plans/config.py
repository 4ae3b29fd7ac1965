"""Parameters of the analysis, with their usual values."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from pathlib import Path


@dataclass(frozen=True)
class Config:
    categories: tuple[str, ...] = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD")
    min_months: int = 24
    smoothing_window: int = 3
    share_floor: float = 0.002
    relative_to_month: bool = True
    blocks: tuple[str, ...] = ("structure", "level", "rhythm")
    weights: dict[str, float] = field(default_factory=lambda: {"structure": 1.0, "level": 1.0, "rhythm": 0.6, "market": 0.5})
    knn: int = 15
    corr_window: int = 12
    corr_min: int = 6
    lag_max: int = 2
    dtw_candidates: int = 60
    dtw_band: int = 2
    road_scale_km: float = 300.0
    hybrid_alpha: float = 0.7
    multiplex_layers: tuple[str, ...] = ("cosine", "residual_corr", "road")
    min_share: float = 0.01
    stability_draws: int = 20
    stability_fraction: float = 0.8
    p_switch: float = 0.03
    min_run: int = 6
    null_block: int = 3
    null_samples: int = 50
    event_theta: float = 0.3
    max_attrs: int = 3
    min_precision: float = 0.5
    min_extent: int = 10

    @classmethod
    def from_yaml(cls, path: str | Path) -> Config:
        """Options of a YAML file, flat or in named sections; a section's option may have a name of its own there."""
        import yaml

        known, out = {f.name for f in fields(cls)}, {}
        for name, value in (yaml.safe_load(Path(path).read_text()) or {}).items():
            inside = value.items() if isinstance(value, dict) and name not in known else [(name, value)]
            for key, option in inside:
                key = IN_SECTIONS.get((name, key), key)
                if key in FLAGS:
                    block, flag = FLAGS[key], bool(option)
                    blocks = [b for b in out.get("blocks", cls.blocks) if b != block]
                    out["blocks"] = [*blocks, *[block] * flag]
                elif key in known:
                    out[key] = option
                elif (name, key) not in ELSEWHERE:
                    raise ValueError(f"unknown option {key} in {name}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in out.items()})


#: Options whose name in a section differs from the field's.
IN_SECTIONS = {
    ("graph", "k"): "knn", ("clustering", "bootstrap"): "stability_draws", ("clustering", "bootstrap_frac"): "stability_fraction", ("temporal", "match_threshold"): "event_theta",
    ("interpretation", "fca_max_attrs"): "max_attrs", ("interpretation", "fca_min_precision"): "min_precision", ("interpretation", "fca_min_extent"): "min_extent",
}
#: Switches of feature blocks.
FLAGS = {"use_rhythm": "rhythm", "use_market_access": "market"}
#: Options of a run that are arguments of the functions here, not of the configuration.
ELSEWHERE = {
    ("seed", "seed"), ("data", "raw_dir"), ("data", "dictionary"), ("graph", "rules"), ("clustering", "k_range"), ("clustering", "methods"), ("clustering", "graph_rules"), ("clustering", "top_for_stability"),
    ("final", "method"), ("final", "rule"), ("final", "k"), ("temporal", "rule"), ("temporal", "lambda_grid"), ("temporal", "multislice_resolution"), ("temporal", "multislice_omega"),
    ("interpretation", "sensitivity_rules"), ("interpretation", "sensitivity_knn"),
}

#: Graph rule -> what it is built from; an index on a graph is fair to a method that shares none of it.
RULE_SOURCES = {
    "cosine": {"features"}, "residual_corr": {"series"}, "lagged_corr": {"series"}, "dtw": {"series"},
    "road": {"road"}, "hybrid": {"features", "road"}, "multiplex": {"features", "series", "road"},
}
FAMILIES = {
    "kmeans": "features", "gmm": "features", "ward": "features", "spectral": "graph", "leiden": "graph",
    "attributed_spectral": "both", "sefnac": "both", "dmon": "both",
}
#: Which indices are better when larger.
HIGHER_IS_BETTER = {"SW": True, "CH": True, "S_Dbw": False, "AVI": True, "AVU": False, "MQ": True}
