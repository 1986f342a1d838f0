"""Operators: DataFrame in, DataFrame out."""

from pseudosignal.operators.admission import admission_control
from pseudosignal.operators.audit import pii_leak_audit
from pseudosignal.operators.delivery import (
    dead_letters,
    delivery_outcomes,
    delivery_state,
    pending_backlog,
    queue_heads,
    retry_budget,
    retry_schedule,
)
from pseudosignal.operators.keys import InstitutionKeys, KeyRing, key_ring
from pseudosignal.operators.matching import (
    cross_institution,
    route_links,
    shared_fingerprints,
    version_partition,
    within_institution,
)
from pseudosignal.operators.metrics import (
    backlog_depth,
    queued_counters,
    signal_rollup,
    synchronous_counters,
)
from pseudosignal.operators.signals import (
    flat,
    payloads,
    pseudonymise,
    receipts,
    sign_payloads,
    wire_json,
)
from pseudosignal.operators.validate import (
    reject_summary,
    rejected_transactions,
    valid_transactions,
    validate_transactions,
)

__all__ = [
    "InstitutionKeys",
    "KeyRing",
    "admission_control",
    "backlog_depth",
    "cross_institution",
    "dead_letters",
    "delivery_outcomes",
    "delivery_state",
    "flat",
    "key_ring",
    "payloads",
    "pending_backlog",
    "pii_leak_audit",
    "pseudonymise",
    "queue_heads",
    "queued_counters",
    "receipts",
    "reject_summary",
    "rejected_transactions",
    "retry_budget",
    "retry_schedule",
    "route_links",
    "shared_fingerprints",
    "sign_payloads",
    "signal_rollup",
    "synchronous_counters",
    "valid_transactions",
    "validate_transactions",
    "version_partition",
    "wire_json",
    "within_institution",
]
