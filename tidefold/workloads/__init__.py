"""Reference workloads as pipelines."""

from tidefold.workloads import health, orderbook, sensor

__all__ = ["health", "orderbook", "sensor"]
