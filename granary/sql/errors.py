"""Errors that a statement's author can mend."""


class SqlError(ValueError):
    """A statement that the dialect does not accept; position is the offset in its text, or -1."""

    def __init__(self, message: str, position: int = -1):
        super().__init__(message if position < 0 else f"{message} (at {position})")
        self.message, self.position = message, position
