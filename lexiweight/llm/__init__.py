"""Operations of a training-data pipeline over documents, pages and embeddings.

Each module holds one operator; ``queries`` applies them to the whole tables.
"""
