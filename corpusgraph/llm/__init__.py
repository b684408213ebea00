"""Operations of a training-data pipeline: tokens, mixing, decontamination, language, chat, duplicates, licences, search, scoring."""
