"""Load-once shared bases for a dashboard-style refresh.

When several outputs read the same derived tables (lots, FY demand, active
lots), ``Workspace`` persists each base once (``MEMORY_AND_DISK``, so a lost
executor's blocks are recomputed from lineage or read from disk) and builds
every output from the persisted frames; ``close()`` releases them.
"""

from __future__ import annotations

from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..operators import alerts as AL
from ..operators import forecast as FC
from ..operators import kpis as K
from ..sources import views as V
from ..sources.tables import Tables


class Workspace:
    def __init__(self, spark: SparkSession, sf_dir: str, params: C.Params = C.DEFAULT,
                 storage: StorageLevel = StorageLevel.MEMORY_AND_DISK):
        self.t = Tables(spark, sf_dir)
        self.p = params
        self.storage = storage
        self._held: list[DataFrame] = []

    def _keep(self, df: DataFrame) -> DataFrame:
        df = df.persist(self.storage)
        self._held.append(df)
        return df

    @cached_property
    def lots(self) -> DataFrame:
        return V.lots(self.t)

    @cached_property
    def fy_lots(self) -> DataFrame:
        start, end = V.bounds(self.t, self.p)
        return self.lots.filter(F.col("procurement_date").between(F.lit(start), F.lit(end)))

    @cached_property
    def demand(self) -> DataFrame:
        return self._keep(V.demand(self.t, self.p))

    @cached_property
    def active(self) -> DataFrame:
        return self._keep(V.active_lots(self.t, self.p.as_of))

    def filtered(self, df: DataFrame, warehouse: str = "All Warehouses", categories=None,
                 warehouse_col: str = "warehouse_name") -> DataFrame:
        """P1 on any base."""
        return K.apply_filters(df, warehouse, categories, warehouse_col)

    def series(self, sku_id: str, warehouse_id: str) -> DataFrame:
        """One (sku, warehouse) series of the demand base."""
        return self.demand.filter((F.col("sku_id") == sku_id) & (F.col("warehouse_id") == warehouse_id))

    def overview(self) -> dict[str, DataFrame]:
        """The overview and alert tables, all from the shared bases."""
        return {
            "wastage_kpi": K.wastage_kpi(self.lots),
            "fill_rate_kpi": K.fill_rate_kpi(self.fy_lots, self.demand),
            "inventory_turnover_kpi": K.inventory_turnover_kpi(self.fy_lots, self.demand),
            "wastage_by_category": K.wastage_by_category(self.lots),
            "wastage_by_month": K.wastage_by_month(self.lots),
            "wastage_by_sku": K.wastage_by_sku(self.lots),
            "risk_level_summary": AL.risk_level_summary(self.active),
            "value_at_risk_by_category": AL.value_at_risk_by_category(self.active),
            "heuristic_forecast": FC.heuristic_forecast(self.demand, self.p),
        }

    def is_empty(self, df: DataFrame) -> bool:
        """P9 at the edge: guard a view before rendering it."""
        return df.isEmpty()

    def close(self) -> None:
        for df in self._held:
            df.unpersist()
        self._held.clear()
