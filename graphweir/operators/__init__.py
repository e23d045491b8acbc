"""Graph, relational and retrieval operators; every one maps DataFrames to DataFrames."""
