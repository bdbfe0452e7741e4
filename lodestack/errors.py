"""What can go wrong, by the part that says so."""


class LodestackError(Exception):
    """Every error of this package."""


class ProvenanceError(LodestackError):
    """An index was made by another provider, model or dimension than is offered."""

    def __init__(self, held: str, offered: str) -> None:
        super().__init__(f"index holds {held}, offered {offered}")
        self.held, self.offered = held, offered


class DimensionError(LodestackError):
    """A vector's length isn't the index's."""


class ChunkerChangedError(LodestackError):
    """The index was made by another chunker version: rebuild it."""


class ProviderRetiredError(LodestackError):
    """The provider is registered as retired."""


class HeaderMismatchError(LodestackError):
    """Header, name and registry of an index don't agree."""


class NoIndexError(LodestackError):
    """There is no such index, or no current one."""


class LockedError(LodestackError):
    """Another writer holds the index."""


class NoRootError(LodestackError):
    """The corpus root isn't a directory."""


class ForbiddenPathError(LodestackError):
    """State may not live under /mnt."""


class BadDateError(LodestackError):
    """Not a date like 2024-01-31."""


class EmbeddingError(LodestackError):
    """The embedder failed, or gave another number of vectors than texts."""


class ConstraintError(LodestackError):
    """Rows break a rule of their table."""


class StaleIndexError(LodestackError):
    """A full-text index is of an older state of its table."""
