"""The derived vector table, kept in parts by the hash of its keys, and rebuilt only where its source has changed.

With the vectors the hash tree of what they were made from is committed. A rebuild makes the tree of the chunks as
they are, compares the two from the root down, and embeds and rewrites only the parts that hold a leaf which differs: new, changed
and vanished chunks alike. Vectors and tree are one batch of the store.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.embedding import Encoder, embed, hashing_encoder
from ..operators import hashtree
from .commits import Store

#: Leaves of the tree and parts of the table; a part holds LEAVES / PARTS leaves.
LEAVES, PARTS = 4096, 64
VECTORS, TREE = "vectors", "vectors_tree"
PLACE = ["document_id", "page_number", "chunk_index"]


def _schemas() -> tuple[StructType, StructType]:
    return (
        StructType.fromDDL("document_id string, page_number int, chunk_index int, embedding array<float>"),
        StructType.fromDDL("level int, node long, n long, total long, mixed long"),
    )


def read(store: Store) -> DataFrame:
    """document_id, page_number, chunk_index, embedding: the committed vectors."""
    snapshot, schema = store.snapshot(), _schemas()[0]
    files = [f"{store.root}/{f}" for table, own in snapshot.files.items() if table.startswith(f"{VECTORS}/") for f in own]
    return store.spark.read.schema(schema).parquet(*files) if files else store.spark.createDataFrame([], schema)


def rebuild(store: Store, chunks: DataFrame, encoder: Callable[[], Encoder] = hashing_encoder) -> list[int]:
    """Brings the vectors up to date with chunks (PLACE and chunk); gives the numbers of the parts that were rewritten.

    What the driver sees is the numbers of parts, PARTS at most. The same chunks give the same table; a rebuild without a change writes nothing.
    """
    batch = store.batch()
    vector_schema, tree_schema = _schemas()
    keyed = chunks.select(F.col("document_id").cast("string").alias("document_id"), F.col("page_number").cast("int").alias("page_number"), F.col("chunk_index").cast("int").alias("chunk_index"), "chunk")
    leaf = hashtree.leaf_of(F.concat_ws("/", *PLACE), LEAVES)
    now = hashtree.tree(keyed, leaf, *PLACE, "chunk")
    changed = hashtree.differing(now, batch.seen.read(TREE, tree_schema))
    part = F.floor(F.col("node") / (LEAVES // PARTS)).cast("int")
    parts = sorted(r[0] for r in changed.select(part.alias("part")).distinct().collect())
    if parts:
        own = keyed.withColumn("part", F.floor(leaf / (LEAVES // PARTS)).cast("int")).where(F.col("part").isin(parts))
        made = own.select("part", *PLACE, embed(F.col("chunk"), encoder).alias("embedding")).repartition("part")
        batch.stage_parts(made, VECTORS, "part", parts)
        batch.stage(now.select(*(F.col(f.name).cast(f.dataType) for f in tree_schema.fields)).coalesce(1), TREE, replace=True)
        batch.commit()
    return parts
