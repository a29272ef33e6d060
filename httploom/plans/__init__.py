"""Named compositions of filters and operators."""
