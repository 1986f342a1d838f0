"""Pseudonymous fraud signals from transaction tables and streams, on Spark."""

from pseudosignal.operators.keys import InstitutionKeys, key_ring
from pseudosignal.operators.signals import pseudonymise
from pseudosignal.session import tune

__all__ = ["InstitutionKeys", "key_ring", "pseudonymise", "tune"]
