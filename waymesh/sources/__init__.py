"""Inputs and outputs of edge tables, palettes, settings and base maps."""
