"""A lazily derived ledger over one driver data directory.

Every attribute is a lazy DataFrame built from the driver's Parquet tables
(fixtures -> quality rules -> clean ledger -> segments -> star model), so each
registered query reads the given tables and its work grows with them.
"""

from __future__ import annotations

import datetime as _dt
import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..config import DEFAULT_RULES, RuleConfig
from ..operators import quality as Q
from ..operators.segments import segment_customers
from ..operators.star import build_dim_customers, build_dim_merchants, build_fact, clean_wide
from ..session import scratch_path
from ..sources.fixtures import Fixtures

RUN_TS = _dt.datetime(2024, 1, 1, 0, 0, 0)


class Ledger:
    """Derived tables over one driver directory.

    With ``materialize=True`` the input tables derived from the driver data
    (raw transactions, the wide star input, the cleaning input) and the two
    expensive intermediates (tagged transactions, cleaned star input) are
    written once as Parquet below the shared ``spark.checkpoint.dir`` and read
    back: multi-pass steps and later queries get parallel scans with column
    pruning and predicate pushdown, the lineage is cut, and a lost executor
    does not lose them. ``materialize=False`` keeps everything lazy.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, cfg: RuleConfig = DEFAULT_RULES,
                 run_ts: _dt.datetime = RUN_TS, materialize: bool = False, spread: int | None = None):
        self.spark = spark
        self.sf_dir = sf_dir
        self.cfg = cfg
        self.run_ts = run_ts
        self.materialize = materialize
        self.spread = spread
        self.fx = Fixtures(spark, sf_dir)
        self._run_dir = f"ledger-{uuid.uuid4().hex}"

    def _stored(self, name: str, df: DataFrame, spread: bool = False) -> DataFrame:
        """Write ``df`` below the checkpoint dir and read it back.

        ``spread`` marks tables derived by plain scans: with the ledger's own ``spread``
        their rows are dealt into that many files before they are written, for inputs
        of a few large row groups; without it they are written as they are read.
        """
        if not self.materialize:
            return df
        path = scratch_path(self.spark, "quillstone", self._run_dir, name)
        if spread and self.spread:
            df = df.repartition(self.spread)
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _marks(self, name: str, df: DataFrame) -> DataFrame:
        """``_stored`` for what goes back to whole rows: broadcast when it has few rows."""
        stored = self._stored(name, df)
        return Q.broadcast_few(stored) if self.materialize else stored

    def marks_new(self, name: str, df: DataFrame) -> DataFrame:
        """``_marks`` under a name of its own: for marks that several queries make each for itself."""
        return self._marks(f"{name}-{uuid.uuid4().hex}", df)

    def stored_new(self, name: str, df: DataFrame) -> DataFrame:
        """``_stored`` under a name of its own: for results that several queries make each for itself."""
        return self._stored(f"{name}-{uuid.uuid4().hex}", df)

    # masters
    @cached_property
    def branches(self) -> DataFrame:
        return self.fx.branches()

    @cached_property
    def merchants(self) -> DataFrame:
        return self.fx.merchants()

    @cached_property
    def customers(self) -> DataFrame:
        return self.fx.customers()

    @cached_property
    def accounts(self) -> DataFrame:
        return self.fx.accounts()

    @cached_property
    def raw(self) -> DataFrame:
        """Raw transactions (an input table: stored once, read by the rules and the raw-level queries)."""
        return self._stored("raw", self.fx.raw_transactions(), spread=True)

    # quality
    @cached_property
    def tagged(self) -> DataFrame:
        return self._stored("tagged", Q.tag_first_match(self.raw, self.accounts, self.customers, self.cfg, keep=self._marks))

    @cached_property
    def anomalies(self) -> DataFrame:
        return Q.anomalies(self.tagged, self.run_ts)

    @cached_property
    def tx(self) -> DataFrame:
        """The clean ledger."""
        return Q.clean(self.tagged, keep=self._marks)

    @cached_property
    def runs(self) -> DataFrame:
        return Q.run_metrics(self.tagged, self.tx, self.run_ts, self.run_ts, run_id=1)

    @cached_property
    def segments(self) -> DataFrame:
        return segment_customers(self.customers, self.run_ts)

    # star model
    @cached_property
    def star_wide(self) -> DataFrame:
        """The cleaned wide star input (median, IQR clip, mode)."""
        return self._stored("star_wide", clean_wide(self._stored("star_input", self.fx.star_wide(), spread=True)))

    @cached_property
    def fact(self) -> DataFrame:
        return build_fact(self.star_wide)

    @cached_property
    def dim_customers(self) -> DataFrame:
        return build_dim_customers(self.star_wide)

    @cached_property
    def dim_merchants(self) -> DataFrame:
        return build_dim_merchants(self.star_wide)

    @cached_property
    def cleaning_input(self) -> DataFrame:
        """The cleaning input (several statistics passes read it)."""
        return self._stored("cleaning_input", self.fx.cleaning_input(), spread=True)

    # streaming input
    @cached_property
    def stream_landing(self) -> str:
        """A landing folder with the stream input in event-time order, and the end-of-input row."""
        from ..streaming.rules import land_files
        stored = self._stored("stream_input", self.fx.stream_input(), spread=True)
        return land_files(stored, scratch_path(self.spark, "quillstone", self._run_dir, "landing"))


    @cached_property
    def shuffled_landing(self) -> str:
        """A landing folder with the stream input in no order of time, and the end-of-input row."""
        from ..streaming.rules import land_shuffled
        stored = self._stored("stream_input_shuffled", self.fx.stream_input(), spread=True)
        return land_shuffled(stored, scratch_path(self.spark, "quillstone", self._run_dir, "landing-shuffled"))


_SESSION_LEDGERS: dict[tuple[str, str], Ledger] = {}


def session_ledger(spark: SparkSession, sf_dir: str) -> Ledger:
    """One materialized ledger per (session, data directory)."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    led = _SESSION_LEDGERS.get(key)
    if led is None:
        local = spark.sparkContext.master.startswith("local")  # one driver file is one row group, hence one task
        led = Ledger(spark, sf_dir, materialize=True, spread=spark.sparkContext.defaultParallelism if local else None)
        _SESSION_LEDGERS[key] = led
    return led
