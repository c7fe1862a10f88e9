"""Every registered query with its oracle SQL (None: rows-only check)."""

from importlib import import_module

MODULES = ("grid_queries", "audit_queries", "context_queries", "research_queries", "model_queries", "decision_queries", "source_queries", "roundtrip_queries")

REGISTRY = {}
for _name in MODULES:
    REGISTRY.update(import_module(f"pulsegrid.queries.{_name}").QUERIES)
