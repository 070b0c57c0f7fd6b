"""Every query of the library by name, and its SQL."""

from __future__ import annotations

from . import catalog
from . import q_audit, q_codec, q_contour, q_files, q_form, q_graph, q_masks, q_raster, q_rays, q_regions, q_relational, q_requests, q_scalar, q_solar, q_space, q_stats, q_streaming, q_vector, q_windows  # noqa: F401


def queries() -> dict:
    return dict(catalog.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(catalog.ORACLES)
