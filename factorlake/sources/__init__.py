"""Landed raw files -> normalised tables, and the tables themselves."""
