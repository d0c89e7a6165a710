"""Totals per zone, the named queries, profiles, fits and map values."""
