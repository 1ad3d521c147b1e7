"""Table schemas and vocabularies of the graph."""

from pyspark.sql import types as T

NODES = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("kind", T.StringType()),
        T.StructField("module", T.StringType()),
        T.StructField("file", T.StringType()),
        T.StructField("line_start", T.IntegerType()),
        T.StructField("line_end", T.IntegerType()),
        T.StructField("signature", T.StringType()),
        T.StructField("docstring", T.StringType()),
        T.StructField("is_public", T.IntegerType()),
        T.StructField("is_test", T.IntegerType()),
        T.StructField("body_hash", T.StringType()),
    ]
)
#: ``file`` is the owner of an edge; ``edge_id`` orders edges and breaks ties of traversals.
EDGES = T.StructType(
    [
        T.StructField("edge_id", T.LongType()),
        T.StructField("src", T.StringType()),
        T.StructField("dst", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("weight", T.IntegerType()),
        T.StructField("scope", T.StringType()),
        T.StructField("detail", T.StringType()),
        T.StructField("file", T.StringType()),
    ]
)
FILE_HASHES = T.StructType([T.StructField("file", T.StringType()), T.StructField("sha256", T.StringType()), T.StructField("indexed_at", T.LongType())])
#: Tokens of a node's texts at their places in one column, and how many it has; ``gen`` is the version that wrote them.
POSTINGS = T.StructType([T.StructField("token", T.StringType()), T.StructField("id", T.StringType()), T.StructField("col", T.IntegerType()), T.StructField("places", T.ArrayType(T.IntegerType())), T.StructField("gen", T.LongType())])
LENGTHS = T.StructType([T.StructField("id", T.StringType()), T.StructField("file", T.StringType()), T.StructField("dl", T.IntegerType()), T.StructField("gen", T.LongType())])

NODE_KINDS = ("function", "method", "class", "variable")
EDGE_KINDS = ("calls", "imports", "mutates", "asserts_on", "side_effect", "inherits", "overrides")
CALLABLE = ("function", "method")
EFFECTS = ("file_io", "network", "cache", "process")
