"""Reconciling and analysing timestamped, speaker-labelled transcripts as lazy Spark DataFrame transforms."""
