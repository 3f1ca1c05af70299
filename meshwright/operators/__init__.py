"""Operators on meshes, graphs and sparse algebra as DataFrame queries."""
