"""Training-data operators: near-duplicates, decontamination, packing,
archives, classifiers and scans over web-scale text. Nothing else in the
library imports this subpackage."""
