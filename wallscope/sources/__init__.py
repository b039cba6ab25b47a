"""Readers and writers: raw logs, network tables, blocklist feeds."""
