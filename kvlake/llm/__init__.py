"""Operations for training-data pipelines. Nothing else in kvlake imports this subpackage."""
