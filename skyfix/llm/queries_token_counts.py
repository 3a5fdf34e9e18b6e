"""Query 7: longest-match token counts of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .queries_pieces import model_path
from .shared import table
from .token_counts import count_tokens


def vocabulary(model_file: str) -> list[str]:
    """The ordinary pieces of a SentencePiece model: no control, unknown or byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    skip = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not any(f(i) for f in skip)]


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), vocabulary(model_path()))


QUERIES = {"op7_token_counts": op7_token_counts}
SQL: dict[str, str] = {}
