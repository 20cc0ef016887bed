"""Data-processing operators that work on any DataFrame; each names its columns by parameters."""
