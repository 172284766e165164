"""Tables, files and streams."""

from .tables import csv_round_trip, json_round_trip, kept, partitioned_sink, scratch, table

__all__ = ["csv_round_trip", "json_round_trip", "kept", "partitioned_sink", "scratch", "table"]
