"""moodgrid — Spark-native short-text sentiment analytics.

Every operator is a function ``DataFrame -> DataFrame`` built from
Spark SQL column expressions, joins, windows and aggregations keyed by
``post_id``.  Sub-packages:

* ``sources``   — table loaders, file scans/sinks, derived fixtures
* ``functions`` — column-expression helpers (text normalisers, tokenisers)
* ``operators`` — features, lexicon joins, mutators, metrics, selection,
                  distance/density
* ``plans``     — multi-step jobs (MLlib training, back-feed loop,
                  k-means restart search, threshold study) and the query
                  catalog used by ``__spark_entry__``
* ``streaming`` — the stateless operators applied to a streaming source
"""

__version__ = "0.1.0"
