"""riskengine: machine-fleet failure-risk analytics on Spark DataFrames.

Sub-packages:
  sources    -- fleet views over the test tables, CSV ingest, scored-run store
  functions  -- column-level helpers (number coercion, rounding, advice texts)
  operators  -- standardisation, features, windows, analytics, modelling, explanations
  plans      -- the registered queries and their SQL oracles
  streaming  -- Structured Streaming scoring, alerts, sinks and windowed KPIs
"""

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Functions of this package that run in Python workers (mapInPandas,
    applyInPandasWithState) are pickled with their code, so executors do not need
    the package installed."""
    import sys

    try:
        from pyspark import cloudpickle

        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except Exception:  # noqa: BLE001 -- older cloudpickle: the package must then be installed on executors
        pass


_ship_by_value()
