"""Error types of the engine."""


class EngineError(Exception):
    """Base of every error that the engine raises by itself."""


class FilterError(EngineError):
    """A filter that isn't well formed."""


class OptionError(EngineError):
    """Find options or updates that can't be applied."""
