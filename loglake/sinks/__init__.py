from loglake.sinks.export import export_logs, export_stacks
from loglake.sinks.rewrite import (
    assign_parts,
    merge_files,
    merge_folder,
    split_by_day,
    split_by_level,
    split_by_size,
)

__all__ = [
    "assign_parts", "export_logs", "export_stacks", "merge_files", "merge_folder", "split_by_day",
    "split_by_level", "split_by_size",
]
