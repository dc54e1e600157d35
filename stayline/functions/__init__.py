from .arrays import (
    displacement,
    flatten_frames,
    lead_major,
    lead_major_batch,
    reshape_frames,
    reshape_frames_batch,
    squared_error,
    zscore_leads,
)
from .hashing import draw
from .labels import (
    contextual_prediction,
    decode_labels,
    encode_labels,
    next_labels,
    transition_targets,
    transition_vector,
)

__all__ = [
    "contextual_prediction",
    "decode_labels",
    "displacement",
    "draw",
    "encode_labels",
    "flatten_frames",
    "lead_major",
    "lead_major_batch",
    "next_labels",
    "reshape_frames",
    "reshape_frames_batch",
    "squared_error",
    "transition_targets",
    "transition_vector",
    "zscore_leads",
]
