"""Column layouts shared by the operators."""

from __future__ import annotations

from pyspark.sql import types as T

# The fixed column order of an exported paper file.
EXPORT_FIELDS = ["title", "llm_summary", "abstract", "pdf_url", "arxiv_id", "url"]

PAPER_CSV = T.StructType([T.StructField(name, T.StringType()) for name in EXPORT_FIELDS])

# One element or one piece of text of a page. Elements have ``tag``, text has
# ``text``. ``pos`` is the index in the page's node array and ``end_pos`` the
# index of the last node inside the element.
NODE = T.StructType(
    [
        T.StructField("pos", T.IntegerType()),
        T.StructField("end_pos", T.IntegerType()),
        T.StructField("tag", T.StringType()),
        T.StructField("class_attr", T.StringType()),
        T.StructField("classes", T.ArrayType(T.StringType())),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
        T.StructField("text", T.StringType()),
        T.StructField("container", T.StringType()),
    ]
)
