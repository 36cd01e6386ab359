"""Registered queries; importing this package registers all of them."""

from assayline.catalog import models, preprocessing, tables  # noqa: F401
from assayline.catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
