"""Errors that the engine raises."""


class EngineError(Exception):
    """Base of all errors of the engine."""


class QuerySyntaxError(EngineError):
    """A pattern query that does not follow the grammar."""


class NotFoundError(EngineError):
    """An id, key or snapshot that does not exist."""


class DimensionError(EngineError):
    """A vector whose length differs from the configured dimension."""


class LimitError(EngineError):
    """A key or value beyond its size limit."""
