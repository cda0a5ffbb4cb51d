"""Every question that SQL can state, by query name."""

from oracle import erp, flow, ingest

ORACLE = {**flow.ORACLE, **erp.ORACLE, **ingest.ORACLE}
