"""Errors of the engine. Bad input is refused before a plan is built."""


class EngineError(Exception):
    """Base of all errors raised here."""


class SchemaError(EngineError):
    """A declaration that contradicts itself or what is already declared."""


class QueryError(EngineError):
    """A query that names what does not exist, or that cannot be built."""


class FilterError(QueryError):
    """A malformed filter, or one on a column that its scope forbids."""


class ValueRefused(EngineError):
    """A value that a column's type does not take."""


class Forbidden(EngineError):
    """An action that a hook or a rule of the table denies."""


class NotFound(EngineError):
    """A row that was asked for by identity and does not exist."""
