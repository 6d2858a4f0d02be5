"""Errors of the engine."""


class EngineError(ValueError):
    """Anything wrong with what a caller passes in."""


class ColumnNamesError(EngineError):
    """A named column is missing."""


class ColumnTypeError(EngineError):
    """A column has a type that its role does not allow."""


class FrameTypeError(EngineError, TypeError):
    """Data of a kind that is no DataFrame."""


class OptionError(EngineError):
    """An option has a value outside its domain."""


class LagsError(OptionError):
    """Lags are not a whole number of at least 1."""


class StepsError(OptionError):
    """Steps ahead are not a whole number of at least 1."""


class QuantilesError(OptionError):
    """Quantiles do not rise from 0 to 1."""


class EstimatorError(OptionError):
    """An object without fit and predict stands for an estimator."""


class SeriesError(EngineError):
    """A series is too short, irregular or holds nulls where it must not."""


class FrequencyError(SeriesError):
    """A series does not have the frequency that it is said to have, or a feature has no sense at it."""


class LengthError(SeriesError):
    """A series is too short."""


class HierarchyError(SeriesError):
    """Levels do not nest, or forecasts do not follow the training data."""


class CovariateError(EngineError):
    """Covariates do not cover the dates that a model needs."""


class CovariateNamesError(CovariateError):
    """Covariates lack a column that a model needs."""


class NotFittedError(EngineError):
    """A model is asked to predict before it was fitted."""


class NotProbabilisticModelError(EngineError):
    """An interval was asked of a model that gives points only."""
