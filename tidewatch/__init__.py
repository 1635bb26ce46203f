"""tidewatch: Spark-native telemetry analytics (event windows, detections, knowledge search, audit)."""

__version__ = "0.1.0"
