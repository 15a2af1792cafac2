"""Readers: file inventories, mount tables, result files, format fingerprints."""
