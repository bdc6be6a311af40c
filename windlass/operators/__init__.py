from .parse import (  # noqa: F401
    encode_metrics, encode_orders, parse_metrics, parse_orders, rejected_orders,
    valid_orders, with_event_time,
)
from .reader import dedupe_metrics, format_metrics, metrics_summary  # noqa: F401
from .windows import (  # noqa: F401
    merge_metrics, merge_partials, order_metrics, order_metrics_session, order_partials,
    order_total_mismatch,
)
