"""lakelens: metadata extraction and data profiling as Spark jobs.

Every public function takes DataFrames (or paths read through Spark) and
returns DataFrames.  Nothing collects data rows to the driver.
"""

from lakelens.functions.types import canonical_class, normalize_types
from lakelens.operators.footer_stats import (footer_table_stats, pushdown_aggregate,
                                             schema_drift)
from lakelens.operators.history import current, fresh, refresh_stale, stale
from lakelens.operators.inventory import (lake_inventory, list_tables, partition_inventory,
                                          partition_row_counts)
from lakelens.operators.metadata import describe_report, full_metadata
from lakelens.operators.profile import (column_stats, merge_partials, profile, profile_partials,
                                        profile_tables, row_counts)
from lakelens.operators.sampling import sample
from lakelens.operators.schema import candidate_keys, schema_inventory, table_schema
from lakelens.sources.deltalog import delta_column_stats, delta_table_stats, snapshot_files
from lakelens.sources.footers import footer_chunks
from lakelens.streaming.incremental import incremental_profile

__all__ = [
    "canonical_class", "normalize_types",
    "footer_table_stats", "pushdown_aggregate", "schema_drift",
    "current", "fresh", "refresh_stale", "stale",
    "lake_inventory", "list_tables", "partition_inventory", "partition_row_counts",
    "describe_report", "full_metadata",
    "column_stats", "merge_partials", "profile", "profile_partials", "profile_tables", "row_counts",
    "sample",
    "candidate_keys", "schema_inventory", "table_schema",
    "delta_column_stats", "delta_table_stats", "snapshot_files",
    "footer_chunks",
    "incremental_profile",
]
