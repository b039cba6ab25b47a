"""The query catalogue: firewall-log views over the test tables, and their oracles."""
