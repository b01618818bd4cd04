"""Named queries over the driver tables (one module per operator family)."""

from reqlens.plans.registry import ORACLES, QUERIES  # noqa: F401
from reqlens.plans import q_exprs, q_filters, q_mixed, q_pivot_overview, q_series, q_sinks_streaming, q_sources, q_stats  # noqa: F401,E402
