"""Typed readers of landed files."""
