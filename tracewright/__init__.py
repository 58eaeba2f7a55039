"""Session-log analytics on Spark: tables, detectors, reports, corpus studies and streams."""
