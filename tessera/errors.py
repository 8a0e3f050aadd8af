"""Errors that guards raise on the driver."""


class RiskError(Exception):
    """What all of them are."""


class DataError(RiskError, RuntimeError):
    """A source or an outcome that can't be worked with."""


class InputError(RiskError, ValueError):
    """An argument or a table that an operator refuses."""


def _kind(name: str, base: type) -> type:
    return type(name, (base,), {"__module__": __name__})


PriceDataError = _kind("PriceDataError", DataError)
FilingsError = _kind("FilingsError", DataError)
FactorLibraryError = _kind("FactorLibraryError", DataError)
ImportSourceError = _kind("ImportSourceError", DataError)
BacktestError = _kind("BacktestError", DataError)
OptimizationError = _kind("OptimizationError", DataError)
ScoresError = _kind("ScoresError", InputError)
PortfolioSpecError = _kind("PortfolioSpecError", InputError)
StatsError = _kind("StatsError", InputError)
RebalanceError = _kind("RebalanceError", InputError)
CovarianceError = _kind("CovarianceError", InputError)
VaRError = _kind("VaRError", InputError)
DecompositionError = _kind("DecompositionError", InputError)
ExposureError = _kind("ExposureError", InputError)
RegressionError = _kind("RegressionError", InputError)
StressError = _kind("StressError", InputError)
