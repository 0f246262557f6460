"""Errors that callers may tell apart."""


class EngineError(Exception):
    """Any error of the engine."""


class IngestionError(EngineError):
    """A source can't be acquired, walked or described."""


class CloneError(IngestionError):
    """Cloning failed for good."""


class UnsupportedRepositoryError(IngestionError):
    """The layout can't be understood."""


class IntelligenceError(EngineError):
    """Parsing or extraction failed."""


class UnsupportedLanguageError(IntelligenceError):
    """No parser is registered for the language."""


class ParseError(IntelligenceError):
    """A file doesn't parse."""


class GraphError(EngineError):
    """The graph failed."""


class NodeNotFoundError(GraphError, KeyError):
    """The graph has no such node."""

    __str__ = Exception.__str__


class DetectionError(EngineError, ValueError):
    """A rule id isn't registered."""


class PatchError(EngineError):
    """A patch can't be applied or rolled back."""


class ValidationError(EngineError):
    """A validator crashed; a verdict of FAIL is no error."""


class SandboxError(EngineError):
    """A command can't be started."""


class SandboxTimeoutError(SandboxError):
    """A command took longer than it may."""
