from . import catalogue, reporting  # noqa: F401
