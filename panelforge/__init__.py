"""panelforge: monthly panel quality, splice and metrics on Spark DataFrames.

Main entry points::

    from panelforge import spec                      # fixed values and spec types
    from panelforge.sources.csv_strict import strict_csv
    from panelforge.operators import contracts, normalize, splice, metrics, headline, warehouse, scale
    from panelforge.streaming.refresh import refresh, landing_stream
    from panelforge.plans import sql                 # the original SQL shapes over the star schema
"""

__version__ = "0.1.0"

__all__ = ["__version__"]
