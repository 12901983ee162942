"""lectern: document analytics and retrieval operators written as PySpark DataFrame transformations."""
