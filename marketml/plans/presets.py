"""Settings of the reference's four scripts, so a run can be repeated by
name (see :func:`marketml.plans.workflows.reference_workflow`)."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class ScriptPreset:
    features: tuple
    label: str
    family: str
    clean_mode: str | None        # None: the columns arrive numeric, no cast
    policy: str = "drop"          # "drop" or "impute"
    drop_columns: tuple = ()
    ablate: tuple = ()
    grid: dict = field(default_factory=dict)
    folds: int = 3


# Feature lists, labels, dropped columns and grids exactly as
# the reference's scripts use them, in their order.
PRESETS: dict[str, ScriptPreset] = {
    "linear": ScriptPreset(
        features=("median_list_price", "median_ppsf", "inventory", "homes_sold", "pending_sales",
                  "new_listings", "months_of_supply", "median_dom", "avg_sale_to_list",
                  "sold_above_list", "price_drops", "off_market_in_two_weeks"),
        label="median_sale_price", family="linear", clean_mode="digits_only",
        grid={"regParam": [0.01, 0.1], "elasticNetParam": [0.0, 0.5, 1.0]}, folds=3,
    ),
    "tree": ScriptPreset(
        features=("inventory", "new_listings", "homes_sold", "median_list_price"),
        label="median_sale_price13", family="tree", clean_mode="try_cast",
        drop_columns=("Unnamed: 58", "PERIOD_BEGIN59", "PERIOD_END60", "REGION_TYPE61",
                      "REGION_TYPE_ID62", "LAST_UPDATED98"),
        grid={"maxDepth": [3, 5, 7]}, folds=3,
    ),
    "forest": ScriptPreset(
        features=("inventory", "homes_sold", "median_list_price", "median_ppsf"),
        label="median_sale_price", family="forest", clean_mode="try_cast", policy="impute",
        grid={"numTrees": [5], "maxDepth": [3]}, folds=2,
    ),
    "gbt": ScriptPreset(
        features=("homes_sold", "pending_sales", "new_listings", "inventory", "months_of_supply",
                  "median_list_price", "median_ppsf", "median_list_ppsf", "price_drops",
                  "avg_sale_to_list", "sold_above_list", "median_dom", "off_market_in_two_weeks",
                  "inventory_yoy", "median_sale_price_yoy"),
        label="median_sale_price", family="gbt", clean_mode=None,
        ablate=("median_list_price",),
        grid={"maxDepth": [3, 5], "maxIter": [50]}, folds=3,
    ),
}

# The columns the boosted script profiles one by one, and its
# correlation-heatmap column list.
SUMMARY_COLUMNS = ("median_sale_price", "homes_sold", "inventory", "months_of_supply", "price_drops")
HEATMAP_COLUMNS = (
    "median_sale_price", "homes_sold", "pending_sales", "new_listings", "inventory",
    "months_of_supply", "median_list_price", "median_ppsf", "median_list_ppsf",
    "price_drops", "avg_sale_to_list", "sold_above_list", "median_dom",
    "off_market_in_two_weeks", "inventory_yoy", "median_sale_price_yoy",
)
