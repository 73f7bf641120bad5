"""Composite searches and evaluation suites built from the operators."""
