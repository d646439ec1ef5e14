from cohortspan.sources.bundles import ModelReadError, read_legacy, read_model, write_model
from cohortspan.sources.manifest import VersionConflict, expire
from cohortspan.sources.text import read_text_table, typed

__all__ = [
    "ModelReadError",
    "VersionConflict",
    "expire",
    "read_legacy",
    "read_model",
    "read_text_table",
    "typed",
    "write_model",
]
