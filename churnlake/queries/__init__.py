"""Registered queries, grouped by area; importing registers them."""

from churnlake.queries import foundation, learners, metrics, quality, serving, sinks, training, trees  # noqa: F401
