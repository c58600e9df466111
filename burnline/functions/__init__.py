"""Column functions; see :mod:`burnline.functions.scalar`."""

from .scalar import *  # noqa: F401,F403
