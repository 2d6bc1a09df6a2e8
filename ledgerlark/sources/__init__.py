"""Readers, adapters from the driver tables, and sinks."""
