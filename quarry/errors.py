"""One exception for each way in which a call can be refused."""

from __future__ import annotations


class QuarryError(Exception):
    """Base of all errors raised by the library."""


class InvalidQuery(QuarryError, ValueError):
    """The query can't be answered as written."""


class NoIndex(QuarryError):
    """The collection has no queryable field (transparent mode)."""


class InvalidSchema(QuarryError, ValueError):
    """A field declaration is unknown, ambiguous or impossible."""


class NotAStruct(InvalidSchema):
    """The record type has no fields."""


class InvalidName(QuarryError, ValueError):
    """A collection's name can't be used."""


class UniqueViolation(QuarryError):
    """Two records would share the value of a unique field."""


class NilValue(QuarryError, ValueError):
    """A record to be stored is missing."""


class InvalidKey(QuarryError, ValueError):
    """A key is empty or of the wrong kind."""


class InvalidPatch(QuarryError, ValueError):
    """A patch names an unknown field or a value that does not fit."""


class NilTransaction(QuarryError):
    """A transaction is required."""


class WrongTransaction(QuarryError):
    """A read needs a view, a write needs an update."""


class StoreMismatch(QuarryError):
    """The transaction belongs to another store."""


class TransactionDone(QuarryError):
    """The transaction was committed or closed before."""


class NotVisible(QuarryError):
    """The collection did not exist when the transaction began."""


class Closed(QuarryError):
    """The store was closed."""


class Broken(QuarryError):
    """A commit failed half-way and the store must be opened again."""


class StaleManifest(QuarryError):
    """Another writer has committed since this store read its manifest."""


class InvalidManifest(QuarryError):
    """The manifest is missing or can't be read."""


class HookDepth(QuarryError):
    """Writes made by change hooks are nested too deep."""


class SequenceExhausted(QuarryError):
    """No automatic id is left."""
