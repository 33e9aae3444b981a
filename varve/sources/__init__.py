"""Table scans, table sinks and the model store."""
