"""Errors of the nearest-neighbour engine."""


class KnnError(ValueError):
    """Base of all errors of the engine."""


class InvalidInputData(KnnError):
    """Null, NaN or infinite coordinates."""


class ZeroLengthInput(KnnError):
    """No points."""


class SmallBoxsize(KnnError):
    """Data lie beyond the periodic box."""


class InvalidBoxsize(KnnError):
    """A box length that is NaN, infinite, or of the wrong number."""


class NegativeDataPeriodic(KnnError):
    """Negative coordinates with a periodic box."""


class InvalidAxis(KnnError):
    """The axis isn't one of the dimensions."""


class InvalidK(KnnError):
    """k below 1."""


class DimensionMismatch(KnnError):
    """Queries and data of different dimensions."""


class QueryOutsideBox(KnnError):
    """A query beyond the periodic box; raised while the plan runs."""
