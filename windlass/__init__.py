"""windlass: order-stream window analytics and operational time-series
queries, written as Spark DataFrame plans (batch and Structured Streaming).
"""

__version__ = "0.1.0"
