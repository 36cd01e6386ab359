"""Sample tables on Spark: preprocessing, feature selection, mixtures, maps and ensembles.

Every operator is a function from DataFrames to DataFrames.  Rows stay in
Spark; the driver only sees aggregates whose size depends on the number of
features, components or groups of parameters, never on the number of rows.
"""
