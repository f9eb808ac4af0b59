"""Registered queries: importing this package fills the registry."""

from opslens.plans import (alerts_q, anomaly_q, branches_q, capacity_q, files_q, findings_q, inventory_q, more_q,  # noqa: F401
                           metrics_q,
                           render_q, risk_q, stream_q, text_q, timeline_q)
from opslens.plans.registry import ORACLES, QUERIES  # noqa: F401
