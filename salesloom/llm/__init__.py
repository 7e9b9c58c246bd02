"""Operations of a training-data pipeline: filtering, deduplication, search, mixing, packing."""
