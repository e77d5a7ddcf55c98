"""Error categories; each error carries file:line:column where it is known."""

from __future__ import annotations


class PactumError(Exception):
    category = "error"

    def __init__(self, message: str, pos: tuple[str, int, int] | None = None):
        self.message, self.pos = message, pos
        where = f"{pos[0]}:{pos[1]}:{pos[2]}: " if pos else ""
        super().__init__(f"{where}{self.category}: {message}")


class SyntaxFault(PactumError):
    category = "syntax"


class TypeFault(PactumError):
    category = "type"


class ContractError(PactumError):
    """What the static checks found; `problems` has one error each."""

    category = "contract"

    def __init__(self, message: str, pos=None, problems: list[PactumError] | None = None):
        super().__init__(message, pos)
        self.problems = problems or [self]


class RuntimeFault(PactumError):
    category = "runtime"


class RejectedError(RuntimeFault):
    category = "rejected"


class TagViolation(PactumError):
    category = "tag violation"


class SourceFault(PactumError):
    category = "i/o"
