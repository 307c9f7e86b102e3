"""Errors of the engine."""


class InvalidInput(ValueError):
    """The request or the data breaks a rule of the schema."""


class NotFound(KeyError):
    """A collection, field or document does not exist."""


class AlreadyExists(ValueError):
    """The name is taken."""


class Unsupported(ValueError):
    """The option cannot be combined with this request."""


class ReadOnly(PermissionError):
    """The database was opened for reading only."""
