"""Binary files that tasks write and read, from where all parts of the library share them."""

from stayscope.sources.files import qualified, reading, writing

__all__ = ["qualified", "reading", "writing"]
