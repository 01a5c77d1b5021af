"""Checked queries: each pairs a Spark callable with the SQL it must agree with."""

from breezeframe.catalog.registry import ORACLES, QUERIES  # noqa: F401


def load_all():
    import importlib
    import pkgutil

    for m in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{m.name}")
    return QUERIES, ORACLES
