from .tables import read_table, TABLES
from .adapters import txn_events, txn_lineitem

__all__ = ["read_table", "TABLES", "txn_events", "txn_lineitem"]
