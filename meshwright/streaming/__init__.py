"""Time-stepped output and streams of snapshots."""
