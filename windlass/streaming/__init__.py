from .jobs import (  # noqa: F401
    StreamRun, run_available_now, start_metrics_reader, start_stream,
    stream_log_lines, stream_metrics_summary, stream_order_metrics,
)
