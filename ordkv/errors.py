"""Errors of the engine."""


class StoreError(Exception):
    """Any error of the engine."""


class CorruptionError(StoreError):
    """Stored bytes or catalog entries don't hold what they claim."""


class InvalidError(StoreError):
    """An argument or option out of its range."""


class ProtocolError(StoreError):
    """Bytes that can't be parsed; a connection that sent them should end."""


class StateError(StoreError):
    """A request refused for the state of a session, which goes on."""
