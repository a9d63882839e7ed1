"""Error hierarchy: everything the library raises about data is a ``LatticeError``."""


class LatticeError(ValueError):
    """Base of the library's errors."""


class ParseError(LatticeError):
    """A malformed frame, with its place in the file."""

    def __init__(self, message: str, frame_index: int | None = None, line: int | None = None, column: int | None = None):
        self.bare, self.frame_index, self.line, self.column = message, frame_index, line, column
        where = "" if frame_index is None else f"frame {frame_index}: "
        if line is not None:
            where += f"line {line}" + ("" if column is None else f", column {column}") + ": "
        super().__init__(where + message)


class SchemaError(LatticeError):
    """A frame that does not conform, or a spec that cannot be applied."""

    def __init__(self, message: str, frame_index: int | None = None, name: str | None = None):
        self.frame_index, self.name = frame_index, name
        super().__init__(message)


class BatchError(LatticeError):
    """Frames that cannot share one batch."""


class SchemaWarning(UserWarning):
    """A deviation reported under the conformance ``warn``."""
