"""Errors of the engine. Bad arguments raise ValueError on the driver before any job starts."""


class QuireError(Exception):
    """Base of the engine's errors."""


class NoTextLayerError(QuireError):
    """A source without pages, or whose pages are pictures."""


class SourceNotFoundError(QuireError):
    """No source matches, or a source lacks chunks or vectors."""


class AmbiguousSourceError(QuireError):
    """Several sources match where one is needed."""


class ModelUnavailableError(QuireError):
    """An embedding model can't be loaded here."""
