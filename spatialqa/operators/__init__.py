"""DataFrame-in, DataFrame-out operators over boxes, mask runs, candidates and rounds."""
