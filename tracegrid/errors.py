"""Errors of the query layer, by what a caller did wrong."""


class RequestError(ValueError):
    """A malformed request: both or neither of ids and keys, an empty list, an unknown option."""


class NotFoundError(KeyError):
    """An id or key that the dataset does not have."""


class TooLargeError(ValueError):
    """A request beyond the stated number of cells or traces; found before any data is read."""


class DataError(ValueError):
    """Input that breaks a rule of the data model."""
