"""Whole scans, reports, the binding of the driver's tables to inventories, and the query catalogue."""
