"""Operations of a training-data pipeline: search, media, filters, de-duplication, mixing, tokens, HTML."""
