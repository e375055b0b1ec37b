"""Readers of grids, surfaces, wells and wavelets; see files.py."""
