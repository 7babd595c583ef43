"""Errors by code, and what a process returns for them."""

from __future__ import annotations

#: The names of the codes, in their order.
CODES = (
    "Ok",
    "FileNotFound",
    "FileReadError",
    "FileWriteError",
    "EmptyScene",
    "NoMeshData",
    "DegenerateMesh",
    "InvalidProjectionString",
    "PROJPipelineFailed",
    "GeoreferencingNotInitialized",
    "SimplificationFailed",
    "InsufficientControlPoints",
    "FitFailed",
    "InvalidArgument",
    "InternalError",
)


class EngineError(ValueError):
    """An error with one of the ``CODES``."""

    def __init__(self, code: str, message: str = ""):
        if code not in CODES[1:]:
            raise ValueError(f"no such code: {code}")
        super().__init__(f"{code}: {message}" if message else code)
        self.code, self.number = code, CODES.index(code)


def exit_code(error: BaseException | None) -> int:
    """0 without an error, 2 for wrong arguments, 1 for all else."""
    if error is None:
        return 0
    return 2 if isinstance(error, EngineError) and error.code == "InvalidArgument" else 1
