from tidemark.plans.curated import CuratedTable, ensure_database
from tidemark.plans.load import choose_mode, curated_table, load_batch

__all__ = ["CuratedTable", "choose_mode", "curated_table", "ensure_database", "load_batch"]
