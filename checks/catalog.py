"""Imports every module that registers queries."""

from . import chunking  # noqa: F401
from . import ranking  # noqa: F401
from . import tables  # noqa: F401
from . import sources  # noqa: F401
from . import streams  # noqa: F401
from . import more  # noqa: F401
from . import code  # noqa: F401
