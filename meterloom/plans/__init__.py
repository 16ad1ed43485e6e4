"""Whole-table plans: adapters over the shared tables and the query catalog."""
