"""All queries of this subpackage and the SQL of those that SQL can express."""

from . import queries_conversations, queries_decontaminate, queries_page_text, queries_personal_data, queries_pieces, queries_quality
from . import queries_shards, queries_simhash, queries_substrings, queries_token_counts, queries_vectors, queries_web_archive

_MODULES = (
    queries_web_archive, queries_page_text, queries_quality, queries_simhash, queries_decontaminate,
    queries_pieces, queries_token_counts, queries_shards, queries_substrings, queries_personal_data, queries_conversations, queries_vectors,
)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
