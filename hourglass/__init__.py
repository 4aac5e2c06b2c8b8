"""hourglass: clinical cohort analytics as Spark DataFrame operators.

Every public operator is a pure ``DataFrame -> DataFrame`` (or Column)
function, so it composes with ``DataFrame.transform`` and lets Catalyst plan
the whole query.  Sub-packages:

* ``sources``   – table scans, the clinical lens over the driver tables, sinks
* ``functions`` – Column-level helpers (nested paths, codes, dates, casts)
* ``operators`` – cohort, concept search, pivots, panel, labels, profiling,
                  metrics and models
* ``plans``     – registered end-to-end queries and their SQL oracles
* ``streaming`` – incremental (Structured Streaming) form of the hourly panel
"""

__version__ = "0.1.0"
