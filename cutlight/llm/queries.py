"""The queries of this subpackage, in one list for the entry file."""

from cutlight.llm import queries_names, queries_text, queries_time, queries_vectors

MODULES = [queries_names, queries_vectors, queries_time, queries_text]
