"""All registered queries; importing this module registers them."""

from cityjobs.jobs import io_queries, label_queries, osm_queries, product_queries, spatial_queries, terrain_queries  # noqa: F401
from cityjobs.jobs.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
