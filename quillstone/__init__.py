"""Spark-native engine for retrieval corpora: ingest, chunking, indexes, ranking, guards, evaluation, telemetry."""
