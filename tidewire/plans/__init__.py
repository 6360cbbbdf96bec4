"""Domain views on the driver tables, queries and their SQL."""
