"""Structured Streaming jobs."""

from pseudosignal.streaming.admission import read_depth, read_verdicts, start_admission
from pseudosignal.streaming.commits import clean, compact, read_committed, start_committed
from pseudosignal.streaming.ingest import (
    read_counters,
    read_output,
    read_rollup,
    start_ingest,
    start_line_ingest,
    start_signal_sink,
)
from pseudosignal.streaming.rollup import (
    late_rows,
    read_aside,
    read_windows,
    start_windowed_rollup,
    untimed_rows,
    window_counts,
    windowed_rollup,
)

__all__ = [
    "clean",
    "compact",
    "late_rows",
    "read_aside",
    "read_committed",
    "read_counters",
    "read_depth",
    "read_output",
    "read_rollup",
    "read_verdicts",
    "read_windows",
    "start_admission",
    "start_committed",
    "start_ingest",
    "start_line_ingest",
    "start_signal_sink",
    "start_windowed_rollup",
    "untimed_rows",
    "window_counts",
    "windowed_rollup",
]
