"""Query catalogue (``catalog``), DuckDB twins (``oracle``) and pipeline drivers (``jobs``)."""
