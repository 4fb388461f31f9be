"""skarn: a DataFrame-native analytics engine for code graphs, tables, documents and memory logs."""

__version__ = "0.1.0"
