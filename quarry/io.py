"""Facade with the survey's proposed names for sources and sinks."""

from quarry.sources.readers import (  # noqa: F401
    load,
    load_many,
    read_csv,
    read_excel,
    read_json,
    sniff_encoding,
    write_table,
)
