"""Lodestone: vector analytics on Spark tables.

Vectors, proximity graphs, quantiser codes, label postings and update logs are
ordinary DataFrames; the modules below declare plans over them. ``lodestone.index``
holds the persisted index.
"""

__version__ = "0.2.0"
