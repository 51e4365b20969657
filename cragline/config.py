"""Parameters of breakline extraction. Zero means "choose from the data" for the cell and both slopes."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields


#: The least and greatest that a request may ask for; the first two must be over their least.
LIMITS = {
    "min_face_area_m2": (0.0, None), "min_line_length_m": (0.0, None), "line_smooth_window": (3, 51), "vertex_spacing_m": (0.20, 5.0), "max_ground_gap_m": (0.0, 10.0),
}


@dataclass(frozen=True)
class ExtractConfig:
    #: fixed values: the defaults that a run without parameters has
    cell_size: float = 0.0
    slope_low_deg: float = 0.0
    slope_high_deg: float = 0.0
    min_face_area_m2: float = 4.0
    min_line_length_m: float = 2.0
    smooth_sigmas_cells: tuple[float, ...] = (0.8, 1.5, 3.0)
    min_scale_persistence: int = 2
    morphology_radius_cells: int = 1
    min_gradient_coherence: float = 0.50
    cross_section_bin_factor: float = 1.0
    line_smooth_window: int = 11
    vertex_spacing_m: float = 1.0
    tin_snap_search_m: float = 1.25
    max_ground_gap_m: float = 1.50
    refine_radius_factor: float = 2.5
    refine_min_points: int = 8
    use_ground_class: bool = True
    ground_class: int = 2
    classification_filter: tuple[int, ...] | None = None
    max_points_for_spacing: int = 80_000
    random_seed: int = 1337

    def __post_init__(self):
        object.__setattr__(self, "smooth_sigmas_cells", tuple(float(s) for s in self.smooth_sigmas_cells))
        if self.classification_filter is not None:
            object.__setattr__(self, "classification_filter", tuple(int(c) for c in self.classification_filter))

    def to_dict(self) -> dict:
        """JSON-ready: tuples become lists."""
        return {k: list(v) if isinstance(v, tuple) else v for k, v in asdict(self).items()}

    @classmethod
    def from_dict(cls, values: dict) -> ExtractConfig:
        """From a mapping; names it does not know are an error."""
        known = {f.name for f in fields(cls)}
        if unknown := set(values) - known:
            raise ValueError(f"unknown parameters: {', '.join(sorted(unknown))}")
        return cls(**values)

    def checked(self) -> ExtractConfig:
        """Itself, if every parameter is within LIMITS; what a service does with a request before it runs."""
        for name, (least, most) in LIMITS.items():
            value = getattr(self, name)
            low = value <= least if most is None else value < least
            if low or (most is not None and value > most) or value != value:
                raise ValueError(f"{name} is out of range: {value}")
        return self

    def selected_classes(self) -> tuple[int, ...] | None:
        """Classes a strict filter keeps, sorted and distinct; None keeps every point."""
        if self.classification_filter is not None:
            return tuple(sorted(set(self.classification_filter))) or None
        return (int(self.ground_class),) if self.use_ground_class else None


#: Standard point classes of the LAS format.
CLASS_NAMES = {
    0: "Created, never classified", 1: "Unclassified", 2: "Ground", 3: "Low vegetation", 4: "Medium vegetation", 5: "High vegetation",
    6: "Building", 7: "Low point (noise)", 8: "Model key-point", 9: "Water", 10: "Rail", 11: "Road surface", 12: "Overlap",
    13: "Wire - guard", 14: "Wire - conductor", 15: "Transmission tower", 16: "Wire - connector", 17: "Bridge deck", 18: "High noise",
}


def classes_for_auto(enabled: bool, chosen: list[int], seen: list[int]) -> list[int] | None:
    """Class request of the automatic run: off -> None, everything chosen -> [], else the sorted choice."""
    if not enabled:
        return None
    picked = sorted(set(chosen))
    return [] if set(seen) and set(seen) <= set(picked) else picked


def classes_for_click(enabled: bool, chosen: list[int], seen: list[int]) -> list[int] | None:
    """Class request of the clicked face: off or everything chosen -> None."""
    return classes_for_auto(enabled, chosen, seen) or None


def classes_for_terrain(seen: list[int]) -> list[int] | None:
    """Ground only, if ground was seen or nothing was seen yet; else no filter."""
    return [2] if not seen or 2 in seen else None
