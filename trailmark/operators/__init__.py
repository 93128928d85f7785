"""Questions and graph operators over typed DataFrames."""
