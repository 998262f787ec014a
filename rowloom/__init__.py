"""rowloom: Spark jobs over very large annotated count matrices.

A matrix is three tables sharing integer keys: ``obs`` (rows), ``var``
(columns) and ``X`` in a sparse, dense or wide layout.  Everything here takes
and returns DataFrames; Spark plans, shuffles and runs the work.
"""
