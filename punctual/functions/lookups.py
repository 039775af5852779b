"""Small fixed lookups. They are literals of the plan, so no join and nothing to broadcast."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Customer code -> channel label.
CUSTOMER_LABELS = {
    "Z41102": "express",
    "Z41103": "hyper",
    "Z41104": "partner",
    "Z41105": "Super / MKTI",
    "Z41108": "B2B",
}

# Exception code -> root-cause cluster.
REASON_CLUSTERS = {
    "late_dispatch": "Transport/Dispatch",
    "early_dispatch": "Transport/Dispatch",
    "last_minute_change": "Customer/Order Mgmt",
    "wms_tms_mismatch": "IT/Integration",
    "insufficient_stock": "Inventory",
    "picking_delay": "Operations/Picking",
    "unknown": "Unknown",
}

# Cluster -> (recommended action, owner, expected lift in percentage points).
RECOMMENDATIONS = {
    "Transport/Dispatch": ("Herbekijk cut-off tijden en herkalibreer transportplanning", "Transport", 1.0),
    "Customer/Order Mgmt": ("Herzie order lock-time afspraken met klant", "Account Mgmt", 0.7),
    "IT/Integration": ("Controleer WMS–TMS interfaces en corrigeer mapping", "IT", 0.4),
    "Inventory": ("Stockparameters en replenishment-cycli bijstellen", "Supply Chain", 0.6),
    "Operations/Picking": ("Capaciteitsplanning en pick-sequentie optimaliseren", "Operations", 0.5),
    "Other": ("Voer Gemba-walk en 5-Why analyse uit", "Quality", 0.3),
    "Unknown": ("Label data verbeteren en exceptions registreren", "Process Excellence", 0.2),
}


def lookup(key: Column, table: dict, default) -> Column:
    """Value for ``key``, or ``default`` where the key is missing or unknown."""
    out = None
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default))


def customer_label(code: Column, default: str) -> Column:
    return lookup(code, CUSTOMER_LABELS, default)


def reason_cluster(reason: Column) -> Column:
    """No reason is ``Unknown``; a reason outside the list is ``Other``."""
    return F.when(reason.isNull() | (reason == ""), "Unknown").otherwise(
        lookup(reason, REASON_CLUSTERS, "Other")
    )


def recommendation(cluster: Column, field: int) -> Column:
    values = {k: v[field] for k, v in RECOMMENDATIONS.items()}
    return lookup(cluster, values, values["Other"])
