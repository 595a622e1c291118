"""Column-level helpers: native expressions only (no Python UDFs)."""

from churnlake.functions.columns import *  # noqa: F401,F403
