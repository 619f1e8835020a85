"""Root-cause analysis over multi-modal telemetry, as DataFrame plans."""
