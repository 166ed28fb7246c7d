"""Operations on training text: secrets, duplicates, quality, language, mixing, token files."""
