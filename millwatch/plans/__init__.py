"""Composed jobs and the catalogue of named queries."""
