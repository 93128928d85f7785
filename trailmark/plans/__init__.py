"""Multi-step jobs: building, merging and validating a graph."""
