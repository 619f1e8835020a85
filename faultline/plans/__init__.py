"""End-to-end plans: raw telemetry to evaluated rankings."""
from .root_cause import METHODS, offline, register  # noqa: F401
