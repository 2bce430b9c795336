"""Descriptor configuration from a small YAML file."""

from __future__ import annotations

from dataclasses import fields

from placerec.config import DescriptorConfig


def parse_yaml(text: str) -> dict:
    """Nested ``key: value`` maps by indentation; comments and blank lines are passed over."""
    root: dict = {}
    stack = [(-1, root)]
    for line in text.splitlines():
        bare = line.split("#", 1)[0].rstrip()
        if not bare.strip() or ":" not in bare:
            continue
        depth = len(bare) - len(bare.lstrip())
        key, value = (x.strip().strip("'\"") for x in bare.strip().split(":", 1))
        while depth <= stack[-1][0]:
            stack.pop()
        if value:
            stack[-1][1][key] = value
        else:
            stack[-1][1][key] = child = {}
            stack.append((depth, child))
    return root


#: Names in the file, fixed values of the format, and the fields they fill.
NAMES = {
    "num_rings": "rings",
    "num_sectors": "sectors",
    "max_radius": "max_radius",
    "dual_z_layer_enable": "dual_layer",
    "dual_z_split_height": "split_height",
    "dual_z_split_auto": "split_auto",
    "dual_z_split_auto_min": "split_min",
    "dual_z_split_auto_max": "split_max",
    "dual_z_split_auto_bin_size": "histogram_bin",
    "dual_z_split_auto_histogram_max": "histogram_max",
    "dual_z_split_auto_min_layer_fraction": "min_fraction",
    "dual_z_split_auto_min_keyframes": "min_keyframes",
    "origin_height_from_ground": "origin_height",
    "dual_z_low_weight": "lower_weight",
    "dual_z_high_weight": "upper_weight",
    "min_joint_rings": "min_joint_rings",
    "absent_upper_fallback_max_local_fraction": "absent_upper_fraction",
    "absent_upper_fallback_radius": "absent_upper_radius",
    "absent_upper_fallback_min_keyframes": "absent_upper_neighbours",
    "retrieval_height_offset": "height_offset",
    "sector_support_exponent": "support_exponent",
    "vertical_boundary_margin": "boundary_margin",
    "vertical_estimation_enable": "vertical_estimation",
    "vertical_correction_min": "vertical_min",
    "vertical_correction_max": "vertical_max",
    "vertical_stable_fraction": "stable_fraction",
    "candidate_top_k": "shortlist",
    "yaw_top_k": "yaw_top_k",
    "distance_thresh": "distance_threshold",
}


def load_config(text: str, canonicalize: bool = False) -> DescriptorConfig:
    """Keys of ``scan_context``, at the top or under ``/**: ros__parameters: prior_map``; absent ones keep their defaults.

    Field names of :class:`DescriptorConfig` work as well; an unknown key is an error, and so is a file without the section.
    """
    root = parse_yaml(text)
    node = root.get("scan_context")
    for step in ("/**", "ros__parameters", "prior_map", "scan_context") if node is None else ():
        root = root.get(step, {})
        node = root
    if not node:
        raise ValueError("no scan_context section")
    kinds = {f.name: f.type for f in fields(DescriptorConfig)}
    values: dict = {"gravity_canonicalized": canonicalize}
    for key, raw in node.items():
        name = NAMES.get(key, key)
        if name not in kinds or isinstance(raw, dict):
            raise ValueError(f"unknown key {key}")
        values[name] = raw.lower() in ("1", "true", "yes") if kinds[name] == "bool" else int(raw) if kinds[name] == "int" else float(raw)
    return DescriptorConfig(**values)
