"""Readers: paths, registered tables, listings, catalog contents, event logs, file streams."""

from .catalog import (  # noqa: F401
    catalog_tables,
    provider,
    qualify,
    read_many,
    read_registered,
    schema_properties,
)
from .event_logs import jobs, read_event_logs, sql_executions, stages, tasks  # noqa: F401
from .files import (  # noqa: F401
    list_files,
    list_markers,
    read_path,
    row_counts,
    rows,
    stream_path,
    with_path_keys,
)
