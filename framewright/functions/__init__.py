"""Column functions: rounding and strides, names and paths, captions, rotations, normalisation, arrays of a time series."""
