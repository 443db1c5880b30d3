"""Queries; importing the package registers them."""

from strata.plans import claims, evidence, instrument, misc, notes, records, retrieval, series  # noqa: F401
