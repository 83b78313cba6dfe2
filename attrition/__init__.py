"""attrition: multi-class customer retention analytics on Spark DataFrames.

Every operator is a lazy ``f(df, ...) -> DataFrame`` built from Spark SQL
expressions, window functions, joins and Spark ML; the package layout is

* ``functions``  -- Column-level helpers (R-style null semantics, bins, ids)
* ``sources``    -- table loading, CSV with multi-token nulls, sinks, fixtures
* ``operators``  -- the analytical operators (cleaning, features, splits,
                    modelling, evaluation, interpretation, risk scoring)
* ``plans``      -- end-to-end flows and the named query registry
* ``streaming``  -- the row-level scoring operators applied to a stream
"""

__version__ = "0.1.0"
