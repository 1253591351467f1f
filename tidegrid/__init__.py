"""tidegrid: survey-trend and occupancy analytics as PySpark DataFrame operators.

Every operator takes DataFrames and returns DataFrames.  Sub-packages:

``functions``  Column expressions (missing-value rules, links, projection, dates)
``operators``  DataFrame operators (dedup, ranks, grid, polygons, posterior, checks, fits)
``sources``    reading, header normalisation, sinks
``plans``      end-to-end chains built from the operators
``workload``   the registered queries with their SQL oracles
"""
