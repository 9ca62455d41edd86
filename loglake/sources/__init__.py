from loglake.sources.events import events_as_logs, render_lines
from loglake.sources.formats import custom_format, line_format
from loglake.sources.stored import load_entries, save_entries
from loglake.sources.text import (
    detect_formats,
    file_formats,
    lines_of,
    list_files,
    load_report,
    parse_lines,
    read_folder,
    read_glob,
    read_lines,
    read_logs,
    with_line_numbers,
)

__all__ = [
    "custom_format", "detect_formats", "events_as_logs", "file_formats", "line_format", "lines_of",
    "list_files", "load_entries", "load_report", "parse_lines", "read_folder", "read_glob", "read_lines", "read_logs",
    "render_lines", "save_entries", "with_line_numbers",
]
