"""Schemas of the tables of a document world."""

from __future__ import annotations

from pyspark.sql import types as T

#: Place of a fragment: a page's block or a sheet's cell.
LOCATION = "struct<source_type:string,page_number:int,block_id:string,bbox:array<double>,workbook_id:string,sheet_name:string,cell_address:string,row:int,column:int>"

TABLES: dict[str, str] = {
    "documents": "document_id string, filename string, source_path string, document_type string, extension string, size_bytes long, checksum string, page_count int, sheet_count int, extraction_status string, extraction_version string, evidence_schema_version string, metadata string",
    "evidence": f"evidence_id string, source_type string, document_id string, source_path string, filename string, extraction_method string, extraction_version string, extraction_confidence double, raw_value string, text string, formula string, note string, location {LOCATION}, metadata string",
    "facts": f"fact_id string, evidence_id string, document_id string, source_path string, subject_mention string, predicate string, raw_value string, normalized_value string, value_number decimal(38,6), value_date date, normalized_type string, normalized_unit string, extraction_method string, normalization_method string, confidence double, validation_status string, location {LOCATION}",
    "mentions": "mention_id string, mention_text string, entity_type string, document_id string, evidence_id string, confidence double, entity_id string",
    "entities": "entity_id string, entity_type string, name string, aliases array<string>, mention_ids array<string>, confidence double, status string",
    "relationships": "relationship_id string, subject_id string, predicate string, object_id string, evidence_id string, document_id string, confidence double",
    "attributes": "attribute_id string, entity_id string, predicate string, value string, value_number decimal(38,6), value_date date, value_type string, evidence_id string, document_id string, confidence double",
}
#: The key of each table: a row with the same key replaces an earlier one.
KEYS = {"documents": "document_id", "evidence": "evidence_id", "facts": "fact_id", "mentions": "mention_id", "entities": "entity_id", "relationships": "relationship_id", "attributes": "attribute_id"}


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[name])


_COORDINATES = "struct<x0:double,y0:double,x1:double,y1:double>"
_BLOCK = f"struct<block_id:string,document_id:string,page_number:int,text:string,coordinates:{_COORDINATES},image_path:string>"
_CELL = "struct<workbook_id:string,sheet_name:string,cell_address:string,value:string,formula:string,note:string,metadata:struct<data_type:string,number_format:string>>"
#: An extraction result: what was read, and what failed and why.
EXTRACTION = (
    "success array<struct<document_id:string,workbook_id:string,filename:string,document_type:string,source_path:string,metadata:struct<size_bytes:long>,"
    f"pages:array<struct<page_number:int,text:string,blocks:array<{_BLOCK}>>>,sheets:array<struct<workbook_id:string,sheet_name:string,cells:array<{_CELL}>>>>>,"
    "failures array<struct<document_id:string,path:string,error_type:string,error_message:string>>"
)
#: What an extractor says about a batch of fragments.
ASSERTIONS = (
    "entities array<struct<mention_text:string,entity_type:string,confidence:double,source_ref:string>>,"
    "relationships array<struct<subject_mention_text:string,predicate:string,object_mention_text:string,confidence:double,source_ref:string>>,"
    "attributes array<struct<subject_mention_text:string,predicate:string,value:string,value_type:string,confidence:double,source_ref:string>>"
)
QUESTION = "qid string, question string, answer double, answer_type string, reasoning_steps array<string>, shape string, hops int, scored boolean"
