"""Composed plans: model objects (fit / sample / evaluate) and evaluation runs."""
