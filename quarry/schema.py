"""Names and types of the document-retrieval tables, and settings. Sources, the store and requests take their columns from here."""

from __future__ import annotations

from dataclasses import dataclass

DOCUMENTS = "document_id string, filename string, file_type string, file_size int, chunk_count int, created_at timestamp_ntz, deleted_at timestamp_ntz"
METADATA = "struct<source:string,page_number:int,bbox:array<double>,category:string,element_id:string,filename:string,filetype:string,parent_id:string,title:string,column:string,languages:array<string>,semantic_chunk_index:int,image_name:string>"
NODES = f"node_id string, document_id string, parent_id string, node_type string, node_index int, content string, structured_data struct<rows:array<array<string>>>, embedding array<float>, metadata {METADATA}"
BLOCKS = "document_id string, block_ordinal int, block_type string, page_number int, bbox struct<x0:double,top:double,x1:double,bottom:double>, text string, rows array<array<string>>, image_bytes binary, image_name string, category string, element_id string, filename string, filetype string, parent_id string, languages array<string>, title string, column string"
ELEMENTS = "document_id string, element_ordinal int, text string, category string, class_name string, element_id string, page_number int, points array<array<double>>, bbox struct<x0:double,top:double,x1:double,bottom:double>, text_as_html string, image_path string, image_bytes binary, filename string, filetype string, parent_id string, languages array<string>"
REQUESTS = "query_id long, query string, top_k int, search_type string, document_id string, system_instruction string"


@dataclass(frozen=True)
class Settings:
    """Fixed values that results depend on."""

    chunk_size: int = 500
    chunk_overlap: int = 50
    top_k: int = 5
    neighbor_window: int = 1
    children: int = 4
    dimension: int = 1536
    rrf_k: int = 60
    overlap_cap: int = 2000
    prompt_chunk_chars: int = 6000
    max_upload_mb: int = 20
    extensions: tuple[str, ...] = ("pdf",)
    max_retries: int = 1
    retry_base_seconds: float = 1.0
    retry_max_seconds: float = 30.0
    insert_batch: int = 100


SETTINGS = Settings()
