"""The one error a caller of the gate has to handle."""


class GateError(Exception):
    """A source, request or decision that the gate cannot carry out."""
