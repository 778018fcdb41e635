"""Errors with a code, hints and context; every code has one meaning."""

from __future__ import annotations

import re


class RowloomError(Exception):
    code = "RL0000"

    def __init__(self, message: str, code: str | None = None, hints: tuple[str, ...] = (), **context):
        super().__init__(message)
        self.message, self.code, self.hints, self.context = message, code or self.code, tuple(hints), context

    def render(self) -> str:
        lines = [f"[{self.code}] {self.message}", *(f"  {k}: {v}" for k, v in self.context.items()), *(f"  hint: {h}" for h in self.hints)]
        return redact("\n".join(lines))


class ConnectionFailed(RowloomError):
    code = "RL1001"


class IntrospectionFailed(RowloomError):
    code = "RL2001"


class GenerationFailed(RowloomError):
    code = "RL3000"


class CircularDependency(GenerationFailed):
    code = "RL3001"


class UniqueExhausted(GenerationFailed):
    code = "RL3002"


class ExistingDataFailed(GenerationFailed):
    code = "RL3003"


class EmptyReferencePool(GenerationFailed):
    code = "RL3004"


class OutputFailed(RowloomError):
    code = "RL4001"


class MissingTarget(OutputFailed):
    code = "RL4002"


class ConfigInvalid(RowloomError):
    code = "RL5001"


class UnknownKey(ConfigInvalid):
    code = "RL5002"


class MissingVariable(ConfigInvalid):
    code = "RL5003"


class UnknownGenerator(ConfigInvalid):
    code = "RL5004"


class BadVirtualKey(ConfigInvalid):
    code = "RL5005"


class BadScenario(ConfigInvalid):
    code = "RL5006"


class UnknownSourceType(ConfigInvalid):
    code = "RL5007"


class FilterInvalid(ConfigInvalid):
    code = "RL5008"


class PluginInvalid(RowloomError):
    code = "RL6001"


class ParseFailed(RowloomError):
    code = "RL7001"


def redact(text: str) -> str:
    """Passwords in URLs as ***."""
    return re.sub(r"(://[^\s:/@]*:)[^\s@]*@", r"\1***@", text)
