"""Plan shaping (scale.py) and the catalogue of named queries (catalog.py)."""
