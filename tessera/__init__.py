"""tessera: symbol alphabets, code streams and corpus preparation on PySpark."""

from tessera.api import *  # noqa: F403
from tessera.api import __all__ as _names

__version__ = "0.1.0"
__all__ = ["__version__", *_names]
