"""Errors raised by this package."""


class TidemillError(RuntimeError):
    """A request that cannot be carried out as it stands."""
