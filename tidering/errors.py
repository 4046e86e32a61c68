"""Status codes and the exceptions that carry them."""

from __future__ import annotations

# The names of the status codes, by number.
STATUS = (
    "ok", "invalid_argument", "out_of_range", "io_error", "interrupted", "no_space", "corrupt",
    "unsupported", "not_found", "busy", "overwritten", "generation_exhausted", "closed", "internal_error",
)


class RingError(Exception):
    """Carries the name of a status code."""

    def __init__(self, code: str, message: str = ""):
        if code not in STATUS:
            raise ValueError(f"no status code {code!r}")
        super().__init__(f"{code}: {message}" if message else code)
        self.code, self.message = code, message

    def __reduce__(self):
        return RingError, (self.code, self.message)


def invalid(message: str) -> RingError:
    return RingError("invalid_argument", message)
