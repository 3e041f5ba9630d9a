"""Training-data operators: near-duplicate search, scoring, filtering, mixing and packing.

Nothing else in the package imports this subpackage.
"""
