"""Streaming: what this engine covers works on whole series, so nothing here is stateful over a stream.

Fitted pipelines of row-wise stages (scalers, indexers, vector functions, learners) transform streaming DataFrames as
they are; windows and shifts order a finite series and do not.
"""
