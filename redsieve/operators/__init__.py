"""Detection, harvesting, resolution, redaction and evaluation over DataFrames."""
