"""strandline: DataFrame operators for building, screening and judging sequence corpora."""
