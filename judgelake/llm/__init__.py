"""Operations of a training-data pipeline: one module an operator, one a query file."""
