"""The engine over a catalog of tables, and its queries on the driver tables."""
