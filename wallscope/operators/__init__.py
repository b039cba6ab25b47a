"""DataFrame -> DataFrame operators: parsing, prefix joins, enrichment."""
