"""Clinical-text analytics over DataFrames of documents."""
