"""Readers, sinks and the model views of the driver tables."""
