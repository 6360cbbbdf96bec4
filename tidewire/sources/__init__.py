"""Readers of feeds, charts, forecasts and registries."""
