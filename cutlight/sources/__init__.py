"""Sources and sinks."""

from cutlight.sources.tables import load, read_table

__all__ = ["load", "read_table"]
