"""Contract-first record transformations compiled to Spark DataFrame plans."""

from .errors import (
    ContractError,
    PactumError,
    RejectedError,
    RuntimeFault,
    SourceFault,
    SyntaxFault,
    TagViolation,
    TypeFault,
)
from .program import Program

__all__ = ["ContractError", "PactumError", "Program", "RejectedError", "RuntimeFault", "SourceFault", "SyntaxFault", "TagViolation", "TypeFault"]
