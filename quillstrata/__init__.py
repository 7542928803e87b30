"""Disclosure-graph, market-factor and corpus analytics on one Spark session."""
