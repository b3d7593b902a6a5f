"""depotline: wholesale-order analytics on Spark DataFrames.

State tables (warehouse, district, customer, orders, orderline, item, stock)
are DataFrames; every operator takes a request DataFrame and answers all
requests in one Spark job.

Typical use::

    from depotline import load_state, reads, run_log
    state = load_state(spark, "/data/tables")            # snapshot, built once
    reads.stock_level(state, requests_df)                # any number of requests
    out = run_log(spark, state, "/data/client-logs")     # whole transaction files
"""

__version__ = "0.1.0"

__all__ = ["load_state", "reads", "writes", "derived", "checks", "metrics", "report",
           "run_log", "apply_batch", "read_txlog", "stream_replay"]


def __getattr__(name):  # lazy: importing the package does not start Spark work
    if name == "load_state":
        from depotline.sources.adapter import load_state
        return load_state
    if name in ("reads", "writes", "derived", "checks", "metrics", "report"):
        import importlib
        return importlib.import_module(f"depotline.operators.{name}")
    if name == "run_log":
        from depotline.plans.client_run import run_log
        return run_log
    if name == "apply_batch":
        from depotline.plans.chain import apply_batch
        return apply_batch
    if name == "read_txlog":
        from depotline.sources.txlog import read_txlog
        return read_txlog
    if name == "stream_replay":
        from depotline.streaming.stream_replay import stream_replay
        return stream_replay
    raise AttributeError(name)
