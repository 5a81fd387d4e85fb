"""Errors with stable codes, and the exit codes of the command line."""

from __future__ import annotations

#: Code -> exit code of the command line.
EXIT_CODES = {"invalid_argument": 2, "invalid_input": 3, "unsupported_backend": 3, "io_error": 4, "corrupt_index": 4, "build_failure": 5}


class EngineError(Exception):
    """An error with one of the codes above."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code

    @property
    def exit_code(self) -> int:
        return EXIT_CODES.get(self.code, 5)


def require(ok: bool, message: str, code: str = "invalid_input") -> None:
    if not ok:
        raise EngineError(code, message)
