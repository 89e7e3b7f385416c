"""Sources -> chunk index table, reusing the vectors of the previous index."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase import schemas
from lorebase.operators import indexing, postings
from lorebase.providers.base import Provider, embed_column
from lorebase.session import persist_table
from lorebase.sources.files import or_empty


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The chunks of an index; an index that does not exist is empty."""
    return or_empty(spark, schemas.CHUNK + ", model STRING, dimensions INT, reused BOOLEAN", lambda: spark.read.parquet(path))


def open_index(spark: SparkSession, path: str) -> postings.Blocks | DataFrame:
    """An index to be searched by blocks; one without grams, or none at all, is a plain table of chunks."""
    try:
        return postings.Blocks(spark.read.parquet(path), spark.read.parquet(f"{path}-grams"))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return read_index(spark, path)


def reusable(index: DataFrame, model: str, dimensions: int) -> DataFrame:
    """Vectors of another model or size are of no use."""
    return index.filter((F.col("model") == model) & (F.col("dimensions") == dimensions))


def indexed_chunks(sources: DataFrame, previous: DataFrame | None, provider: Provider | None, dimensions: int = 512,
                   embed_limit: int | None = None) -> DataFrame:
    """Chunks with vectors: taken over where the text is unchanged, embedded where not, null without a provider.

    Only the missing texts are sent to the provider; ``embed_limit`` is the service's input limit.
    """
    chunks = indexing.reuse_vectors(indexing.chunk_sources(sources), previous)
    chunks = chunks.withColumn("reused", F.col("vector").isNotNull())
    if provider is None:
        return chunks.withColumn("model", F.lit(None).cast("string")).withColumn("dimensions", F.lit(dimensions))
    wanted = F.when(F.col("vector").isNull(), indexing.embedding_input(embed_limit))
    embedded = chunks.withColumn("_new", embed_column(wanted, provider))
    return embedded.withColumn("vector", F.coalesce("vector", "_new")).drop("_new").withColumns(
        {"model": F.lit(provider.model), "dimensions": F.lit(dimensions)}
    )


def build_index(spark: SparkSession, sources: DataFrame, path: str, version: str, provider: Provider | None = None,
                previous_version: str | None = None, force: bool = False, block_chunks: int = postings.BLOCK_CHUNKS) -> DataFrame:
    """Write ``path/<version>`` and return its manifest row.

    Each run writes a new version next to the old one and reads the old one for reuse, so a lost executor or a failed
    run never leaves a half-written index. ``force`` embeds everything anew.
    """
    old = None
    if previous_version and not force and provider is not None:
        old = reusable(read_index(spark, f"{path}/{previous_version}"), provider.model, 512)
    columns = [f.split()[0] for f in schemas.CHUNK.replace("MAP<STRING,STRING>", "MAP").split(", ")]
    index = indexed_chunks(sources, old, provider).select(*columns, "model", "dimensions", "reused")
    postings.write_blocks(persist_table(index, "index"), f"{path}/{version}", block_chunks)
    return indexing.index_manifest(spark.read.parquet(f"{path}/{version}"))
