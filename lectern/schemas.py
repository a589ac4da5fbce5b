"""Schemas of the document model."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType, BooleanType, DoubleType, IntegerType, StringType, StructField, StructType,
)


def _struct(**fields) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields.items()])


_S, _I, _B, _D = StringType(), IntegerType(), BooleanType(), DoubleType()
_STRINGS, _INTS = ArrayType(_S), ArrayType(_I)

MANIFEST = _struct(
    material_id=_S, file_hash=_S, relative_path=_S, file_type=_S, domain=_S, collection=_S,
    ingested_at=_S, ingested_by=_S)
PAGE = _struct(
    material_id=_S, page_number=_I, text=_S, headings=_STRINGS, section_boundaries=_STRINGS,
    annotation_ids=_STRINGS, table_refs=_STRINGS)
CHUNK = _struct(
    material_id=_S, chunk_id=_S, text=_S, source_pages=_INTS, emphasized=_B,
    annotation_overlap_ids=_STRINGS, content_class=_S)
ANNOTATION = _struct(
    material_id=_S, annotation_id=_S, type=_S, page=_I, quoted_text=_S, comment=_S, color=_S,
    rect=ArrayType(_D))
FIGURE = _struct(
    material_id=_S, figure_id=_S, source_page=_I, image_path=_S, bbox=ArrayType(_D),
    extraction_method=_S, visual_type=_S, description=_S, caption=_S, relevance=_S)
CONCEPT = _struct(
    material_id=_S, concept_name=_S, descriptor=_S, concept_type=_S, relevance=_S,
    source_pages=_INTS, evidence_spans=_STRINGS, confidence=_D)
CLUSTER = _struct(
    cluster_id=_S, domain=_S, collection=_S, canonical_name=_S, slug=_S, aliases=_STRINGS,
    descriptor=_S, material_ids=_STRINGS, confidence=_D)
TABLE = _struct(material_id=_S, table_id=_S, headers=_STRINGS, rows=ArrayType(_STRINGS))
