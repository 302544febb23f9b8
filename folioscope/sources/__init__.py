"""Readers and writers: artifacts, snapshots, page fetching."""
