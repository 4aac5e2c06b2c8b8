"""Registered queries (registry), their DuckDB oracles (oracle, lens_sql) and the flagship model (icu_model)."""
