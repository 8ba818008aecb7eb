"""probspark: probabilistic models over DataFrames of any size."""

__version__ = "0.1.0"
