"""All queries of the library but those of the optional corpus subpackage."""

from __future__ import annotations

from pathglow.plans import query_areas, query_detection, query_lateral, query_more, query_rules, query_spatial  # noqa: F401  registers
from pathglow.plans.registry import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "unmapped_peaks"
