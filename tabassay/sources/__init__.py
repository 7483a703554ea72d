"""Reading, combining, fingerprinting and writing tables."""

from .tables import (  # noqa: F401
    CATALOG,
    TableInfo,
    concat_tables,
    fingerprint,
    load_table,
    read_csv,
    read_table,
    spread_table,
    table_info,
    typed_csv,
    write_splits,
    write_table,
)
