"""Composed plans: incident facts, marts, KPIs, index sync and retrieval."""
