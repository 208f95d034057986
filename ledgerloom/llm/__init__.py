"""Operations of a training-data pipeline: filters, de-duplication, search and packing over document tables."""
