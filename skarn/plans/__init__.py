"""Registered queries: each module has QUERIES (name to function of session and folder) and ORACLES (name to SQL)."""

MODULES = ["tabular", "graphs", "texts", "systems", "more", "problems", "reports"]
