"""Queries over the driver's tables, and tables that cut lineage."""
