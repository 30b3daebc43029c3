"""All operators; importing this module fills the registry."""

from . import dedup, filters, language, mappers, media, selectors  # noqa: F401
