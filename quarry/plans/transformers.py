"""The steps of the contextual ingest as ``pyspark.ml`` transformers (T5).

Each step is a ``Transformer`` with parameters; ``ingest_pipeline`` puts them
into one ``PipelineModel`` that is saved, loaded and applied like any other,
so an ingest is described by a folder instead of code.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.chunk import TOKEN_CHUNK_OVERLAP, TOKEN_CHUNK_SIZE, markdown_sections, page_estimate, token_chunks
from quarry.operators.embed import EMBED_DIM, embed_input, with_vectors
from quarry.operators.enrich import extractive_context, lead_sentence
from quarry.session import stage


class _Step(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """A transformer whose parameters have defaults and are set by keyword."""

    def _start(self, defaults: dict, given: dict) -> None:
        self._setDefault(**defaults)
        self._set(**given)

    def get(self, name: str):
        return self.getOrDefault(self.getParam(name))


class SectionChunker(_Step):
    """Markdown documents (id, text) to token chunks of their sections:
    chunk_id, src_doc, header_path, chunk_index, n_chunks, text and the
    section's first sentence."""

    idCol = Param(Params._dummy(), "idCol", "column of the document id", TypeConverters.toString)
    textCol = Param(Params._dummy(), "textCol", "column of the Markdown text", TypeConverters.toString)
    chunkSize = Param(Params._dummy(), "chunkSize", "tokens of a chunk", TypeConverters.toInt)
    chunkOverlap = Param(Params._dummy(), "chunkOverlap", "tokens that two chunks share", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, idCol="doc_id", textCol="text", chunkSize=TOKEN_CHUNK_SIZE, chunkOverlap=TOKEN_CHUNK_OVERLAP):
        super().__init__()
        self._start({"idCol": "doc_id", "textCol": "text", "chunkSize": TOKEN_CHUNK_SIZE, "chunkOverlap": TOKEN_CHUNK_OVERLAP}, self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        docs = dataset.select(F.col(self.get("idCol")).alias("src_doc"), F.col(self.get("textCol")).alias("text"))
        sections = markdown_sections(docs, "src_doc").select(
            F.concat_ws("-", F.col("src_doc").cast("string"), F.col("section_index").cast("string")).alias("section_id"),
            "src_doc", "header_path", "text", lead_sentence("text").alias("lead"))
        return token_chunks(sections, self.get("chunkSize"), self.get("chunkOverlap"), id_col="section_id",
                            keep=("src_doc", "header_path", "lead")).drop("section_id")


class ContextWriter(_Step):
    """Adds the page estimate and the context line of every chunk."""

    pageCol = Param(Params._dummy(), "pageCol", "column for the page", TypeConverters.toString)
    contextCol = Param(Params._dummy(), "contextCol", "column for the context", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, pageCol="page_number", contextCol="context"):
        super().__init__()
        self._start({"pageCol": "page_number", "contextCol": "context"}, self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        context = extractive_context(F.col("src_doc").cast("string"), "chunk_index", "n_chunks", "lead", header_path="header_path")
        return dataset.withColumn(self.get("pageCol"), page_estimate("chunk_index")).withColumn(self.get("contextCol"), context)


class HashedEmbedder(_Step):
    """Adds the hashed embedding of every chunk's text, with its context in
    front unless ``mode`` is ``text``. The chunks are read twice and written
    once to the shared folder."""

    contextCol = Param(Params._dummy(), "contextCol", "column of the context", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "column for the vector", TypeConverters.toString)
    dim = Param(Params._dummy(), "dim", "numbers of a vector", TypeConverters.toInt)
    mode = Param(Params._dummy(), "mode", "context+text or text", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, contextCol="context", outputCol="embedding", dim=EMBED_DIM, mode="context+text"):
        super().__init__()
        self._start({"contextCol": "context", "outputCol": "embedding", "dim": EMBED_DIM, "mode": "context+text"}, self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        chunks = stage(dataset, "embedder")
        text = embed_input("text", F.col(self.get("contextCol")), self.get("mode"))
        return with_vectors(chunks.withColumn("embed_text", text), "chunk_id", "embed_text", self.get("dim"), self.get("outputCol"),
                            joined=True).drop("embed_text")


def ingest_pipeline(chunk_size: int = TOKEN_CHUNK_SIZE, chunk_overlap: int = TOKEN_CHUNK_OVERLAP, dim: int = EMBED_DIM,
                    mode: str = "context+text") -> PipelineModel:
    """Chunker, context and embedding as one model; nothing has to be fitted."""
    return PipelineModel([SectionChunker(chunkSize=chunk_size, chunkOverlap=chunk_overlap), ContextWriter(), HashedEmbedder(dim=dim, mode=mode)])
