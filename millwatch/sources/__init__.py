"""Schemas, readers, sinks and the mapping of generic event tables to machine logs."""
