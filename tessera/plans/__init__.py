"""Query plans over the driver tables, one module for each operator family."""

import importlib
import pkgutil


def load_all() -> None:
    """Imports every plan module, which registers its queries."""
    for m in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{m.name}")
