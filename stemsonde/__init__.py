"""Perturbation-audit analytics over annotated symbol sequences, on Spark.

Every operator takes and returns DataFrames.  The layers, bottom up:

``functions``  column expressions (brackets, vectors, special functions, draws)
``sources``    panels, alignments, FASTA, stored results, sinks
``operators``  structure, variants, joins, aggregates, vectors, scores, tests
``plans``      whole audits built from operators
``streaming``  resumable, stamp-guarded scoring
``catalog``    the query set over the driver tables, with oracle SQL
"""
