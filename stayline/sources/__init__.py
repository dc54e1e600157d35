from .tables import (
    load_vocabulary,
    read_array_table,
    read_metadata,
    read_recordings,
    save_vocabulary,
    vocabulary_frame,
    write_bucketed,
    write_pairs,
    write_recordings,
)

__all__ = [
    "load_vocabulary",
    "read_array_table",
    "read_metadata",
    "read_recordings",
    "save_vocabulary",
    "vocabulary_frame",
    "write_bucketed",
    "write_pairs",
    "write_recordings",
]
