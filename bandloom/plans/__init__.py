"""The library's registered queries; importing this package registers them."""

from . import bundles, calibration, comparison, files, frames, frequencies, grids, ingest, matrices, sessions, streams  # noqa: F401
