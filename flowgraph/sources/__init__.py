"""Graphs derived from event and order tables, and random graphs."""
