"""Text mining on Spark: new-word and compound-word discovery as DataFrame plans.

Subpackages: ``sources`` (readers and writers), ``functions`` (column expressions), ``operators`` (DataFrame to
DataFrame), ``plans`` (whole analyses and plan utilities), ``streaming`` (the stateless stages on streams).
"""
