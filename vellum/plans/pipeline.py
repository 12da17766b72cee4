"""The document pipeline as one plan: layout, structure, chunks, quality."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.config import PipelineConfig
from vellum.operators import chunking, layout, quality, structure

VERSION = "0.1"


@dataclass(frozen=True)
class Result:
    documents: DataFrame
    pages: DataFrame
    page_texts: DataFrame
    sections: DataFrame
    units: DataFrame
    pieces: DataFrame
    parents: DataFrame
    children: DataFrame
    report: DataFrame
    issues: DataFrame


def stamp(df: DataFrame) -> DataFrame:
    """With the version that made it."""
    return df.withColumn("pipeline_version", F.lit(VERSION))


def run(documents: DataFrame, pages: DataFrame, blocks: DataFrame, tables: DataFrame, config: PipelineConfig | None = None, table=lambda df, _: df) -> Result:
    """All steps. ``table(df, name)`` may write an intermediate and read it back, so that the folds run once; without it
    the plan is lazy throughout."""
    config = config or PipelineConfig()
    kept, kinds, good_tables = layout.parse_layout(blocks, pages, tables, config.parser, table)
    kept = table(kept, "blocks")
    _, units = structure.build_structure(kept, good_tables, kinds, config.parser, table)
    units = table(units, "units")
    sections = table(structure.sections(units), "sections")
    parents, children, pieces = chunking.chunk(sections, units, documents, config.chunk, config.semantic, table)
    parents, children = table(parents, "parents"), table(children, "children")
    report, issues = quality.validate(documents, kinds, parents, children, pieces, config.chunk, config.quality)
    return Result(documents, kinds, layout.page_text(kept, good_tables), sections, units, pieces, stamp(parents), stamp(children), report, issues)
