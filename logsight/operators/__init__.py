"""Joins, aggregates, windows, detectors, graph and alert operators."""
