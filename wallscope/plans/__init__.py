"""Reports over parsed and enriched logs, and the jobs that run them."""
