"""Scoring of modelled against observed site series, on Spark."""
