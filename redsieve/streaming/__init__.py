"""The stateless and the scope-wise operators on streams."""
