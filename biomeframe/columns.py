"""Fixed column names of the canonical tables."""

SAMPLE = "sampleID"
DEPTH = "read_count"
LABEL = "HC_subCST"
PRED = "subCST"
TAXON = "taxon"
COUNT = "count"
VALUE = "value"
