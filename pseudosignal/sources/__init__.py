"""Transaction sources and signal sinks."""

from pseudosignal.sources.json_lines import decode_transactions, read_lines
from pseudosignal.sources.sinks import (
    read_signals,
    shared_folder,
    write_rejects,
    write_signals,
    write_wire_text,
)
from pseudosignal.sources.tables import conform, read_transactions

__all__ = [
    "conform",
    "decode_transactions",
    "read_lines",
    "read_signals",
    "read_transactions",
    "shared_folder",
    "write_rejects",
    "write_signals",
    "write_wire_text",
]
