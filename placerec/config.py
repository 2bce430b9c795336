"""Descriptor configuration; invalid values raise."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

#: Hard limits of a descriptor database.
MAX_RINGS, MAX_SECTORS, MAX_CELLS, MAX_ENTRIES = 512, 4096, 1_000_000, 100_000


@dataclass(frozen=True)
class DescriptorConfig:
    rings: int = 20
    sectors: int = 60
    max_radius: float = 80.0
    dual_layer: bool = False
    split_auto: bool = False
    gravity_canonicalized: bool = False
    vertical_estimation: bool = False
    split_height: float = 2.5
    origin_height: float = 0.0
    vertical_shift: float = 0.0
    height_offset: float = 0.1
    lower_weight: float = 0.3
    upper_weight: float = 0.7
    min_joint_rings: int = 2
    support_exponent: float = 0.5
    shortlist: int = 5
    search_ratio: float = 0.05
    yaw_top_k: int = 3
    distance_threshold: float = 0.5
    histogram_max: float = 8.0
    histogram_bin: float = 0.1
    split_min: float = 1.5
    split_max: float = 4.5
    min_fraction: float = 0.05
    min_keyframes: int = 20
    absent_upper_fraction: float = 0.05
    absent_upper_radius: float = 10.0
    absent_upper_neighbours: int = 3
    boundary_margin: float = 0.1
    stable_fraction: float = 0.5
    vertical_min: float = -1.5
    vertical_max: float = 1.5

    def __post_init__(self):
        if not (0 < self.rings <= MAX_RINGS and 0 < self.sectors <= MAX_SECTORS and self.rings * self.sectors * 2 <= MAX_CELLS):
            raise ValueError("rings and sectors out of range")
        if not (math.isfinite(self.max_radius) and self.max_radius > 0):
            raise ValueError("max_radius must be positive")
        if min(self.lower_weight, self.upper_weight) < 0 or self.lower_weight + self.upper_weight <= 0:
            raise ValueError("weights must be non-negative and not all zero")
        if self.min_joint_rings < 1 or self.shortlist < 1 or self.yaw_top_k < 1 or not 0 <= self.search_ratio <= 0.5:
            raise ValueError("search parameters out of range")
        if not (self.histogram_bin > 0 and self.histogram_max > self.histogram_bin and self.split_min <= self.split_max):
            raise ValueError("histogram parameters out of range")
        if not all(math.isfinite(x) for x in (self.split_height, self.origin_height, self.vertical_shift, self.height_offset, self.support_exponent)):
            raise ValueError("heights must be finite")

    @property
    def layers(self) -> int:
        return 2 if self.dual_layer else 1

    @property
    def search_radius(self) -> int:
        """Half away from zero, as ``round`` in Spark."""
        return int(math.floor(self.search_ratio * self.sectors + 0.5))

    def with_(self, **changes) -> DescriptorConfig:
        return replace(self, **changes)

    def compatible(self, other: DescriptorConfig, any_split: bool = False) -> bool:
        """Whether descriptors of both can be compared."""
        kind = lambda c: (c.rings, c.sectors, c.max_radius, c.dual_layer, c.gravity_canonicalized)
        same = kind(self) == kind(other)
        return same and (any_split or abs(self.split_height - other.split_height) <= 1e-9)
