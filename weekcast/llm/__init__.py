"""Operations of a training-data pipeline: search, quality, tokens, mixing, chat, toxicity, duplicates, secrets."""
