"""Queries over the catalogue and signals, and their SQL twins."""

from sonolith.plans import audio, catalog, library, rhythm, shows, signals

MODULES = (library, catalog, signals, rhythm, shows, audio)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
