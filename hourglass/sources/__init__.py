"""Scans (tables), feature-table sinks (sinks) and the clinical lens over the driver tables (lens)."""
