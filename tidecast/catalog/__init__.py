"""Every operator as a query over the given tables, with the SQL that checks it."""


def load() -> None:
    """Import the modules that register queries."""
    import importlib

    for name in ("panels", "windows", "vintages", "scores", "sources", "models", "composites"):
        importlib.import_module(f"tidecast.catalog.{name}")
