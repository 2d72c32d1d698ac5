"""All registered queries: importing the modules below adds theirs to the registry."""

from canopy.plans import benchmark_queries, catalog_queries, design_queries, differ_queries, learning_queries, matcher_queries, nesting_queries, novelty_queries, pixel_queries, raster_queries, recurring_queries, review_queries, source_queries, stream_queries, verdict_queries
from canopy.registry import FLAGSHIP, ORACLES, QUERIES

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES", "benchmark_queries", "catalog_queries", "differ_queries", "learning_queries", "matcher_queries", "nesting_queries", "novelty_queries", "pixel_queries", "review_queries", "source_queries", "stream_queries"]
