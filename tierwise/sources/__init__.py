"""Inputs of the engine: order lines, dimension files and stored tables."""
