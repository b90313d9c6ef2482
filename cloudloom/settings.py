"""Settings of an import, presets, and an immutable snapshot of both."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields, replace

#: What each preset sets.
PRESETS: dict[str, dict[str, float]] = {
    "fast": {"import_chunk_size": 500_000, "density": 0.35, "max_display_points": 1_000_000, "sampling_target": 250_000, "max_points_sampled": 50_000, "octree_max_points_per_node": 80_000, "octree_max_depth": 7, "color_economy_threshold": 500_000},
    "balanced": {"import_chunk_size": 1_000_000, "density": 1.0, "max_display_points": 2_000_000, "sampling_target": 500_000, "max_points_sampled": 100_000, "octree_max_points_per_node": 50_000, "octree_max_depth": 8, "color_economy_threshold": 750_000},
    "quality": {"import_chunk_size": 1_600_000, "density": 1.0, "max_display_points": 3_000_000, "sampling_target": 750_000, "max_points_sampled": 200_000, "octree_max_points_per_node": 35_000, "octree_max_depth": 9, "color_economy_threshold": 1_100_000},
}


@dataclass(frozen=True)
class Settings:
    point_size: int = 3
    max_display_points: int = 2_000_000
    density: float = 1.0
    sampling_target: int = 500_000
    import_chunk_size: int = 1_000_000
    startup_cap: int = 250_000
    invalidate_interval_ms: int = 200
    batch_vertices_limit: int = 250_000
    chunk_capacity: int = 100_000
    max_points_sampled: int = 100_000
    octree_max_points_per_node: int = 50_000
    octree_max_depth: int = 8
    color_mode: str = "original"
    color_gradient: str = "viridis"
    single_color: str = "#ffffff"
    import_preset: str = "balanced"
    color_economy_threshold: int = 750_000

    @classmethod
    def normalized(cls, values: dict[str, object]) -> Settings:
        """Settings from loose values (as text, too): what is unknown is dropped, what is invalid takes its default."""
        base, out = cls(), {}
        for f in fields(cls):
            if f.name not in values:
                continue
            default, value = getattr(base, f.name), values[f.name]
            try:
                if f.name == "density":
                    number = float(value)
                    out[f.name] = min(max(number, 0.01), 1.0) if number - number == 0 else default
                elif f.name == "point_size":
                    out[f.name] = min(max(int(float(value)), 1), 10)
                elif isinstance(default, int):
                    number = int(float(value))
                    out[f.name] = number if number > 0 else default
                elif f.name == "import_preset":
                    key = str(value).strip().lower()
                    out[f.name] = key if key in PRESETS or key == "custom" else "custom"
                else:
                    out[f.name] = str(value)
            except (TypeError, ValueError, OverflowError):
                out[f.name] = default
        return replace(base, **out)

    def with_preset(self, name: str) -> Settings:
        name = name.strip().lower()
        return replace(self, **PRESETS[name], import_preset=name) if name in PRESETS else replace(self, import_preset="custom")

    def changed(self, **values: object) -> Settings:
        """New values; one that a preset controls makes the preset `custom`."""
        new = Settings.normalized(asdict(self) | values)
        own = {k for p in PRESETS.values() for k in p}
        return replace(new, import_preset="custom") if own & values.keys() and "import_preset" not in values else new

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Settings:
        return cls.normalized(json.loads(text))
