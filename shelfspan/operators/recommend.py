"""What to pull from the panel for a client file, from its profile."""

from __future__ import annotations

from shelfspan.operators.panel import SYNONYMS
from shelfspan.operators.schema import Detection

#: Fields of the panel that a comparison uses, and the one that it can do without.
OPTIONAL_FIELDS = ("volume_sales",)
REQUIRED_FIELDS = tuple(f for f in SYNONYMS if f not in (*OPTIONAL_FIELDS, "brand_low"))
#: How many values of a scope are named.
NAMED = {"market": 6, "category": 10, "manufacturer": 6, "brand": 12}
#: What each comparison mode means for the reader.
CAVEATS = {
    "directional": ("The file looks like shipments: coverage can be read, deltas show a direction only.", "No conversion between measures is applied."),
    "comparable": ("The file looks like retail sales: where the export has the recommended grain, deltas compare like with like.",),
    "not_comparable": ("Key fields are missing, so a comparison may be blocked.",),
}


def recommend(profile: dict, found: Detection) -> dict:
    """Scopes, measures, fields and caveats of the export to pull; `profile` is the report of `profile.build`."""
    total = [m["value"] for m in profile["markets"] if m.get("total_like")]
    detail = [m["value"] for m in profile["markets"] if not m.get("total_like")]
    more = f" (+{len(detail) - NAMED['market']} more)" if len(detail) > NAMED["market"] else ""
    scope = [f"'{total[0]}' is a total: pull the closest total market of {profile['customer'] or 'the retailer'}."] if total else []
    if detail:
        scope.append(f"Map the client's own markets ({', '.join(detail[: NAMED['market']])}{more}) to the closest panel markets, or start with the total.")
    values = lambda key, of: [v["value"] for v in profile[key]][: NAMED[of]]
    return {
        "country": "US",
        "recommended_dataset": "Panel retail sales",
        "customer_scope": [profile["customer"]] if profile["customer"] else [],
        "market_scope": scope or ["No market field: pull the retailer's total market."],
        "category_scope": values("categories", "category"),
        "manufacturer_scope": values("manufacturers", "manufacturer"),
        "brand_scope": values("brands", "brand"),
        "period_start": profile["period_start"],
        "period_end": profile["period_end"],
        "time_grain": profile["time_grain"],
        "product_grain": "code or item, else brand or category",
        "required_measures": ["Dollar sales", "Unit sales"] + ["Volume sales if available"] * ("volume" in found.metrics),
        "required_fields": list(REQUIRED_FIELDS),
        "optional_fields": list(OPTIONAL_FIELDS),
        "comparison_mode": found.mode,
        "caveats": [*CAVEATS[found.mode], *(["The client's markets are its own and need a mapping."] if detail else [])],
    }
