"""Packet-filter firewall log analytics on Spark DataFrames."""
