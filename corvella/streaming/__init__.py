"""Streams: progress of jobs, and rescans on new manifest rows."""
