"""Operators: bars, indicators, market structure, signals, flows, events."""
