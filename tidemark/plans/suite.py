"""The tables a query needs, and the published views."""

from dataclasses import dataclass, replace
from datetime import date
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import alerting, audit, dashboard, marts, security
from tidemark.sources import seeds, warehouse


@dataclass(frozen=True)
class Suite:
    """Marts over one set of core tables. Frames are lazy; nothing runs here."""

    fact: DataFrame
    customers: DataFrame
    plans: DataFrame
    thresholds: DataFrame
    # Bound to one publication: all tables are of the same load.
    wh: warehouse.Warehouse | None = None
    user: str | None = None
    policy: DataFrame | None = None
    # The month that latest-month marts are about; the newest one by default.
    as_of: date | None = None

    @classmethod
    def over(cls, wh: warehouse.Warehouse, thresholds=None, user=None, policy=None, as_of=None) -> "Suite":
        """The suite as one user sees it; without a user, everything."""
        wh = wh.bound()
        policy = wh.read(warehouse.POLICY) if policy is None else policy
        return cls(
            fact=security.visible_fact(wh.read(warehouse.FACT), policy, user),
            customers=wh.read(warehouse.CUSTOMERS),
            plans=seeds.plans(wh.spark),
            thresholds=wh.read(warehouse.THRESHOLDS) if thresholds is None else thresholds,
            wh=wh,
            user=user,
            policy=policy,
            as_of=as_of,
        )

    def at(self, as_of: date | None) -> "Suite":
        """The same suite with latest-month marts as of another month."""
        return replace(self, as_of=as_of)

    @cached_property
    def regions(self) -> list[str] | None:
        """The regions that a restricted user may see."""
        if self.user is None:
            return None
        return sorted({r.region for r in security.allowed(self.policy, self.user).collect()})

    @cached_property
    def month(self):
        """The month of latest-month marts, as a value that prunes partitions where it is known."""
        if self.as_of is not None:
            return F.lit(self.as_of)
        if self.wh is None:
            return self.fact.select(F.max("date_key")).scalar()
        # What one user sees may end in an earlier month than what was loaded.
        newest = self.wh.published().newest(self.regions)
        return F.lit(None if newest is None else date.fromisoformat(newest))

    @property
    def log(self):
        return self.wh and self.wh.get(warehouse.LOG)

    @cached_property
    def mrr(self):
        return marts.mrr_monthly(self.fact)

    @cached_property
    def drill(self):
        return marts.revenue_drilldown(self.fact, self.customers, self.plans)

    @cached_property
    def drill_latest(self):
        # The month filter passes the grouping and reaches the fact scan.
        return marts.newest(self.drill, "month", self.month)

    @cached_property
    def cohorts(self):
        return marts.cohort_retention(self.fact)

    @cached_property
    def at_risk(self):
        return marts.accounts_at_risk(self.fact, self.customers, self.plans, self.month)

    @cached_property
    def region_months(self):
        return marts.region_months(self.fact)

    @cached_property
    def region_totals(self):
        return security.region_totals(self.fact)

    @cached_property
    def alerts(self):
        return marts.raised(self.region_months)

    @cached_property
    def active_alerts(self):
        # Without a stated month, the newest one that has an alert row.
        return alerting.active_alerts(self.alerts, self.thresholds, self.as_of and F.lit(self.as_of))

    @cached_property
    def threshold_alerts(self):
        return alerting.threshold_alerts(alerting.metrics_of(self.region_months), self.thresholds)

    @cached_property
    def mix(self):
        return marts.revenue_mix(self.fact, self.plans)

    @cached_property
    def mix_latest(self):
        return marts.newest(self.mix, "month", self.month)

    @cached_property
    def health(self):
        return marts.health_signals(self.fact)

    @cached_property
    def customer_bits(self):
        return marts.customer_bits(self.fact, self.customers, self.plans)

    def distinct_customers(self, *by, first=None, last=None, **slicers):
        """Distinct customers under slicers and between two months, by some of month, region, segment, plan_name and channel."""
        rows = dashboard.slice_rows(self.customer_bits, **slicers)
        if first is not None:
            rows = rows.filter(F.col("month") >= F.lit(first))
        if last is not None:
            rows = rows.filter(F.col("month") <= F.lit(last))
        return marts.distinct_customers(rows, *by)


class StoredSuite(Suite):
    """The suite as its last load left it: marts are added up from stored cells.

    A restricted user reads the partitions of the regions that the policy gives, and no others.
    """

    def _visible(self, table, region="region"):
        return security.visible(self.wh.read(table), self.policy, self.user, region)

    @cached_property
    def cells(self):
        return self._visible(warehouse.CELLS)

    @cached_property
    def mrr(self):
        return marts.mrr_of(self.cells)

    @cached_property
    def drill(self):
        return marts.drilldown_of(self.cells)

    @cached_property
    def region_months(self):
        return marts.region_months_of(self.cells)

    @cached_property
    def region_totals(self):
        return marts.region_totals_of(self.cells)

    @cached_property
    def mix(self):
        return marts.mix_of(self.cells)

    @cached_property
    def health(self):
        return marts.health_of(self.cells)

    @cached_property
    def customer_bits(self):
        return self._visible(warehouse.BITS)

    @cached_property
    def cohorts(self):
        if self.user is not None and len(self.regions) > 1:
            # A customer's first month in either of several regions is not in the cells of each.
            return super().cohorts
        cohort = "cohort_month" if self.user is None else "cohort_here"
        return marts.cohorts_of(self._visible(warehouse.COHORTS), cohort)

    @cached_property
    def at_risk(self):
        state = self.wh.published()
        month = self.as_of.isoformat() if self.as_of else state.newest(self.regions)
        if month in state.boards:
            return marts.newest(self._visible(warehouse.AT_RISK, "seen_in"), "last_active_month", self.month).select(
                *AT_RISK_COLUMNS
            )
        return super().at_risk


AT_RISK_COLUMNS = [
    "customer_id",
    "region",
    "segment",
    "plan_name",
    "channel",
    "last_active_month",
    "churn_risk_score",
    "usage_score",
    "support_tickets",
    "failed_payments",
    "risk_tier",
    "monthly_revenue",
]

# View name -> suite attribute and the order a reader gets by default.
VIEWS = {
    "v_mrr_monthly": ("mrr", [("month", True)]),
    "v_revenue_drilldown": ("drill", [("month", True)]),
    "v_cohort_retention": ("cohorts", [("cohort_month", True), ("period_num", True)]),
    "v_accounts_at_risk": ("at_risk", [("churn_risk_score", False)]),
    "v_alerts": ("alerts", [("date_key", False)]),
    "v_active_alerts": ("active_alerts", []),
    "v_revenue_mix": ("mix", [("month", True)]),
    "v_health_signals": ("health", [("month", True)]),
    "v_refresh_log": ("log", [("run_ts", False)]),
}


def publish(suite: Suite, names=None) -> list[str]:
    """Registers views for SQL users: the named ones, or all that have data."""
    published = []
    for name in VIEWS if names is None else names:
        df = getattr(suite, VIEWS[name][0])
        if df is None:
            continue
        if name == "v_refresh_log":
            df = df.select(*audit.LOG_COLUMNS)
        df.createOrReplaceTempView(name)
        published.append(name)
    return published


def fetch_view(spark, view, order=None, limit=None) -> DataFrame:
    """Reads a published view with an order of (column, ascending) and a row limit."""
    if view not in VIEWS:
        raise ValueError(f"unknown view {view!r}")
    df = spark.table(view)
    order = VIEWS[view][1] if order is None else order
    if order:
        df = df.orderBy(*[F.asc(c) if up else F.desc(c) for c, up in order])
    return df if limit is None else df.limit(limit)
