"""Fixed schemas and the kinds of an entry."""

from pyspark.sql import types as T

PUT, DELETE = 0, 1

ENTRY = T.StructType(
    [
        T.StructField("key", T.BinaryType(), False),
        T.StructField("seqno", T.LongType(), False),
        T.StructField("kind", T.ByteType(), False),
        T.StructField("value", T.BinaryType()),
    ]
)
#: A batch: ord says the order of operations, kind is PUT or DELETE.
OPS = T.StructType([T.StructField("ord", T.LongType(), False), T.StructField("kind", T.ByteType(), False), T.StructField("key", T.BinaryType(), False), T.StructField("value", T.BinaryType())])
PAIR = T.StructType([T.StructField("key", T.BinaryType(), False), T.StructField("value", T.BinaryType())])
#: What a write buffer charges for a key besides its bytes.
OVERHEAD = 24
#: The largest sequence number.
MAX_SEQNO = 2**63 - 1
