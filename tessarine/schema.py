"""Schemas of the stored relations and the codes of their enumerated columns."""

from __future__ import annotations

from pyspark.sql import types as T

SYMBOL_TYPES = {
    1: "Namespace", 2: "Class", 3: "Struct", 4: "Union", 5: "Enum",
    20: "Function", 21: "Method", 22: "Constructor", 23: "Destructor", 24: "Prototype",
    40: "Include", 60: "Comment", 61: "Macro", 80: "MarkdownHeading1", 81: "MarkdownHeading2",
}
CALLABLE = (20, 21, 22, 23, 24)
CONTAINER = (1, 2, 3, 4, 5, 20, 21, 22, 23, 80, 81)
#: Containers that bound chunks; namespaces span whole files.
CHUNK_CONTAINER = (2, 3, 4, 5, 20, 21, 22, 23)

#: What an index run did with a file.
INDEX_STATUS = {0: "unchanged", 1: "indexed", 2: "deleted", 3: "error"}
#: What a chunking run did with a file.
CHUNK_STATUS = {0: "unchanged", 1: "computed", 2: "error"}
DOCUMENT_TYPE = {0: "standard", 1: "knowledge_base"}

FILES = T.StructType().add("file_id", "long").add("file_path", "string").add("sha256", "string")
CHUNKS = (
    T.StructType().add("chunk_id", "long").add("file_id", "long").add("start_line", "integer").add("end_line", "integer").add("sha256", "string").add("vector_id", "long")
)
VECTORS = T.StructType().add("vector_id", "long").add("embedding", T.ArrayType(T.FloatType()))
DELETED_CHUNKS = T.StructType().add("sha256", "string").add("vector_id", "long").add("touched_at", "long")
VECTOR_CACHE = T.StructType().add("sha256", "string").add("data", "string")

#: Lines of symbols count from 0, their end line is inclusive, their end column exclusive.
SYMBOL = (
    T.StructType()
    .add("type", "integer").add("name", "string")
    .add("start_line", "integer").add("start_column", "integer").add("end_line", "integer").add("end_column", "integer")
    .add("name_start_line", "integer").add("name_start_column", "integer").add("name_end_line", "integer").add("name_end_column", "integer")
    .add("scope", "string").add("fully_qualified_name", "string").add("signature", "string")
    .add("header_end_line", "integer").add("header_end_column", "integer")
)
#: Lines of chunks count from 1, both ends inclusive.
CHUNK = T.StructType().add("start_line", "integer").add("end_line", "integer").add("text", "string").add("sha256", "string")

RANGE = T.StructType().add("filePath", "string").add("startLine", "integer").add("endLine", "integer")
TRAINING = (
    T.StructType().add("query", "string").add("queryType", "string").add("positive", RANGE).add("hardNegatives", T.ArrayType(RANGE)).add("easyNegatives", T.ArrayType(RANGE))
)
MUTATIONS = T.StructType().add("path", "string").add("action", "string").add("seq", "long")
