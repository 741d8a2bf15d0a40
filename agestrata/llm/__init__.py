"""Training-data operators: one module each, all DataFrame in, DataFrame out."""
