"""What can go wrong in a run, by kind."""

from __future__ import annotations


class LeafmillError(Exception):
    """Any error of this library."""


class ConfigError(LeafmillError, ValueError):
    """A site config that is missing, not readable or not valid."""


class FetchError(LeafmillError, RuntimeError):
    """A page that could not be had, or that is not what was asked for."""


class BookError(LeafmillError, ValueError):
    """An e-book that is missing or has nothing to import."""


class ModelError(LeafmillError, RuntimeError):
    """A model's answer that cannot be used."""
