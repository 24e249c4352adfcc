"""What can go wrong, by kind. A row's error is kept as (kind, message)."""


class DataError(Exception):
    """Anything this engine raises about data."""


class ParseError(DataError, ValueError):
    """The text is no such document."""


class ValidationError(DataError, ValueError):
    """The document contradicts itself or its schema."""


class ReferenceIntegrityError(ValidationError):
    """A reference has no target."""


class DownloadError(DataError):
    """A download failed or exceeded its limit."""


class SourceError(DataError):
    """A registry entry or snapshot is unusable."""


class ArchiveError(DataError):
    """An archive can't be read."""


class ComponentError(DataError, LookupError):
    """A component query has no single answer."""


class ComponentNotFound(ComponentError):
    """No identity has this alias."""


class AmbiguousComponent(ComponentError):
    """Several identities have this alias."""


class ResolverError(ComponentError):
    """The external resolver answered with something else."""


class MissingDependency(DataError, ImportError):
    """An optional package is not installed."""
