"""Snapshots of the tables and the programming interface."""
