"""Spatial-transcriptomics tables as Spark jobs: DataFrames in, DataFrames out."""
