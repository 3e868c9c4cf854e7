"""feedlake — social-feed analytics as plain Spark DataFrame jobs.

Every operator is a ``DataFrame -> DataFrame`` function (or a ``Column``
expression) built from Spark SQL built-ins, so Catalyst can prune, push down
and plan shuffles.  Python only runs inside tasks where Spark has no built-in
(the pluggable text encoder).
"""

__version__ = "0.1.0"
