"""What can go wrong, by kind."""


class EngineError(Exception):
    """Base of all."""


class IndexError_(EngineError):
    """A query or a mutation that cannot be meant."""


class StorageError(EngineError):
    pass


class ConfigError(EngineError):
    pass
