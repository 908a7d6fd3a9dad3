"""tidelog: access-log analytics as Spark jobs."""

from tidelog.grains import Grains
from tidelog.operators.annotate import annotate, clean
from tidelog.operators.importance import by_permutation, surrogate
from tidelog.operators.models import add_anomaly
from tidelog.operators.reporting import html_report, text_report
from tidelog.operators.rules import classify, flags, ground_truth, protect_hubs, seeds
from tidelog.plans.pipeline import classify_by_rules, classify_deep, location_profile, run
from tidelog.schema import LogSchema, available_schemas, canonical, get_schema, override, register_schema
from tidelog.sources.readers import read_labels, read_log, read_metadata, register, sample_exact, write_annotated

__version__ = "0.3.0"
__all__ = [
    "Grains", "LogSchema", "add_anomaly", "annotate", "available_schemas", "by_permutation", "canonical", "classify", "classify_by_rules",
    "classify_deep", "clean", "flags", "get_schema", "ground_truth", "html_report", "location_profile", "override", "protect_hubs", "read_labels",
    "read_log", "read_metadata", "register", "register_schema", "run", "sample_exact", "seeds", "surrogate", "text_report", "write_annotated",
]
