"""Operators on road, reading and tile tables."""
