from .files import (  # noqa: F401
    collect_stream, read_orders_files, write_json_lines, write_log_lines, write_report_csv,
)
