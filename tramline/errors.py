"""What can go wrong, by kind."""


class TramlineError(RuntimeError):
    """Base of all errors of this package."""


class ContractError(TramlineError):
    """A table breaks the contract of its source."""


class CanonicalizationError(TramlineError):
    """A label can't be parsed, or the network isn't the one expected."""


class PanelError(TramlineError):
    """A panel isn't rectangular, or not there."""


class GeometryError(TramlineError):
    """Coordinates and stations don't line up."""


class CatalogError(TramlineError):
    """The dataset catalogue doesn't have what was asked for."""


class DownloadError(TramlineError):
    """A download is cut off or isn't the file it should be."""


class LeakageError(TramlineError):
    """A fold tests on days it trains on."""


class ArtifactsUnavailable(TramlineError):
    """Serving tables are missing."""


class NotFound(TramlineError):
    """A query names something that isn't there."""
