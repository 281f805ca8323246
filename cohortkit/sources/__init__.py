"""Readers and writers (K operators) and adapters for the driver's test tables."""
