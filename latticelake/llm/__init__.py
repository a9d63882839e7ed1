"""Operations that a training-data pipeline needs, one module for each operator."""
