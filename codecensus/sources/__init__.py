"""Sources and sinks: corpus tables, listings, decoding, activity, writers."""
