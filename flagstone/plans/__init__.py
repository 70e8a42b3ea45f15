"""Helpers that shape plans: measured small sides, lineage cuts, ordered totals, closures."""
