"""A PySpark-native engine for timed multi-speaker transcripts, the records made from them and linked notes."""
