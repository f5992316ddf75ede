"""Security-scan analytics over tables of source files, as plain ``DataFrame -> DataFrame`` functions."""
