from .scalar import (  # noqa: F401
    JAVA_DOUBLE_MAX, JAVA_DOUBLE_MIN, epoch_ms, fixed, metrics_key, reported_max,
    reported_min, safe_div, threshold_status, value_text,
)
