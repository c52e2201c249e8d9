"""Readers and writers of recordings, segments, features, labels, cohorts and thresholds."""
