"""Column-level building blocks: text, addresses, services."""
