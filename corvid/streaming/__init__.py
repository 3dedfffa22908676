"""Stateful rules over event streams, each with a batch twin of the same step function."""
