"""Queries over the test tables; importing this package registers them."""

from . import catalogue, details, items, jobs, monitor, operations, records, snapshots, storage, streams, texts  # noqa: F401
