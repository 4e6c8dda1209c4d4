"""revlens: review-corpus analytics expressed as Spark DataFrame plans.

Every public operator takes DataFrames (and plain parameters) and returns a
DataFrame; nothing is collected to the driver.  Sub-packages:

- ``sources``   readers, fixture loaders and sinks
- ``functions`` Column-expression builders (cleaning, tokenising) and fixed word lists
- ``operators`` relational/ML operators grouped by theme
- ``plans``     the registered named queries and their SQL oracles
- ``streaming`` row-wise cleaning on streaming DataFrames
"""

__version__ = "0.1.0"
