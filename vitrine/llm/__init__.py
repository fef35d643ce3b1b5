"""Operations of a training-data pipeline, each a Spark job over a documents, pages or embeddings table."""
