"""Fixed schemas of the tables that flow between stages."""

from pyspark.sql import types as T

NODE = T.StructType([
    T.StructField("node_id", T.IntegerType()),       # preorder, starting at 1
    T.StructField("parent_id", T.IntegerType()),     # 0 is the document
    T.StructField("grand_id", T.IntegerType()),
    T.StructField("end_id", T.IntegerType()),        # last node of the subtree
    T.StructField("kind", T.StringType()),           # e element, t text, c comment
    T.StructField("tag", T.StringType()),
    T.StructField("cls", T.StringType()),
    T.StructField("id_attr", T.StringType()),
    T.StructField("in_link", T.BooleanType()),
    T.StructField("text", T.StringType()),           # text nodes, entities decoded
    T.StructField("raw", T.StringType()),            # markup as found, see nodes.py
    T.StructField("path", T.ArrayType(T.IntegerType())),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
])

COMMENT = T.StructType([
    T.StructField("page_url", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("published", T.StringType()),
])

PAGE_INDEX = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("links", T.ArrayType(T.StringType())),
    T.StructField("source_id", T.LongType()),
    T.StructField("profile_id", T.LongType()),
    T.StructField("referring_source_id", T.LongType()),
    T.StructField("etag", T.StringType()),
    T.StructField("raw", T.StringType()),
    T.StructField("published", T.TimestampNTZType()),
    T.StructField("updated", T.TimestampNTZType()),
    T.StructField("lang", T.StringType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("evaluation", T.LongType()),
    T.StructField("cached_tag_list", T.StringType()),
])

SOURCE = T.StructType([
    T.StructField("source_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("category_id", T.LongType()),
])

STORED_COMMENT = T.StructType([
    *COMMENT.fields[:-1],
    T.StructField("published", T.TimestampNTZType()),
    T.StructField("comment_id", T.StringType()),     # of page and content
])

SITE_RULE = T.StructType([
    T.StructField("host_slug", T.StringType()),
    T.StructField("tag", T.StringType()),
    T.StructField("selector", T.StringType()),
])
