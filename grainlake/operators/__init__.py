"""Operators on grids, graphs, matrices and segments."""
