"""The base tables. Every group, join and window of the engine is within a package_id."""

from __future__ import annotations

from pyspark.sql import DataFrame

OCCURRENCES = """
package_id string, document_id string, traversal_index int, original_filename string, original_relative_path string,
original_extension string, original_size_bytes long, original_sha256 string, status string, is_ignored_artifact boolean,
is_portfolio_container boolean, portfolio_parent_document_id string, archive_chain_display string, converted_page_count int,
converted_size_bytes long
"""
RAW_PAGES = """
package_id string, document_id string, page_index int, raw_text string, width double, height double, rotation int,
form_fields array<struct<name:string,field_type:string,value:string>>,
annotations array<struct<subtype:string,contents:string,has_appearance_stream:boolean>>,
images array<struct<byte_sha256:string,perceptual_hash:bigint,average_color:struct<r:double,g:double,b:double>,is_blank:boolean,width:int,height:int>>
"""
DECISIONS = "package_id string, match_id string, decision string, document_id string, decided_at timestamp, reason string"

# Fixed values.
STATUSES = ["discovered", "converted", "unconverted_placeholder", "ignored_system_artifact"]
FINAL_STATUSES = ["converted", "unconverted_placeholder", "ignored_system_artifact"]
OUTCOMES = ["success", "fallback_success", "failed"]


def conform(df: DataFrame, schema: str) -> DataFrame:
    """The columns of a schema in its order and types; absent ones are null, others go."""
    from pyspark.sql import functions as F
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(schema).fields
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
