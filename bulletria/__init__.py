"""Bulletins to records, and corpora to training data, on Spark."""

from .operators.envelope import build_envelopes, conform, envelope_schema_ddl, validate_envelope_json, violations, write_schema_file
from .operators.parse import parse_bytes, parse_files, parse_layouts
from .sources.readers import read_envelopes, read_layouts, read_texts
from .sources.sinks import Bundles, Config, ModelPolicy, Runtime, write_bundles, write_files

__all__ = [
    "Bundles", "Config", "ModelPolicy", "Runtime", "build_envelopes", "conform", "envelope_schema_ddl", "parse_bytes", "parse_files", "parse_layouts", "read_envelopes", "read_layouts",
    "read_texts", "validate_envelope_json", "violations", "write_bundles", "write_files", "write_schema_file",
]
