"""Column functions and driver-side compilers of patterns."""
