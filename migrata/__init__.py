"""migrata: schema migration and migration verification on Spark DataFrames."""

from .spec import LogContext, Schema, dest_kinds, dest_schema, log_from_dicts, log_to_dicts, validate_schema

__all__ = ["LogContext", "Schema", "dest_kinds", "dest_schema", "log_from_dicts", "log_to_dicts",
           "validate_schema"]
__version__ = "0.1.0"
