"""tasklattice: DataFrame operators for corpora of machine-checkable tasks."""
