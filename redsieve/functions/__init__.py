"""Column builders: policy lists, matches with offsets, scalars, surrogates."""
