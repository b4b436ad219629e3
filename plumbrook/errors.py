"""Errors of this library."""


class PlumbrookError(ValueError):
    """A request that can't be met: wrong names, types, options or statements."""
