"""Thresholds and fractions of the operators, with their defaults (fixed values)."""

from __future__ import annotations

import dataclasses


@dataclasses.dataclass(frozen=True)
class Parameters:
    min_fields: int = 5
    min_methods: int = 10
    min_types: int = 3
    max_types: int = 200
    min_package_term_match: int = 25
    use_package_fields: bool = True
    field_min_match: float = 0.5
    field_max_match: float = 0.75
    constructor_min_match: float = 0.1
    constructor_max_match: float = 0.25
    method_min_match: float = 0.5
    method_max_match: float = 0.75
    enum_match: float = 0.75
    class_min_match: float = 0.60
    class_max_match: float = 0.75
    class_cutoff: float = 0.5
    attr_cutoff: float = 0.5
    method_cutoff: float = 0.5
    depend_cutoff: float = 0.33
    score_cutoff: float = 0.50
    interface_fraction: float = 0.25
    enum_fraction: float = 0.75
    word_fraction: float = 0.20
    convention_type: str | None = None
    convention_local: str | None = None
    convention_parameter: str | None = None
    convention_field: str | None = None
    convention_constant: str | None = None
    convention_method: str | None = None
    remove_unused: bool = False
    tight_filter: bool = True

    def non_defaults(self) -> dict:
        """Names and values that differ from the defaults."""
        return {f.name: v for f in dataclasses.fields(self) if (v := getattr(self, f.name)) != f.default}


DEFAULTS = Parameters()
