"""Incremental processing of arriving tiles and events."""
