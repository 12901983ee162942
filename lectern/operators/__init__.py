"""DataFrame to DataFrame operators: search, fusion, structure, tables, relations, evaluation."""
