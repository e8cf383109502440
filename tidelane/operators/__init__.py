"""Operators on media-timeline tables: DataFrame in, DataFrame out, with key and order columns as parameters."""
