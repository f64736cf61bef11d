"""The claims tables, derived from the given order tables.

One claim per order, one beneficiary row per customer and year, and a fixed score per inpatient
claim. FIXTURES.md states the mapping. Options leave out what a query does not read, because an
outer join that only adds unread columns would still be executed.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimlens.columns import CONDITIONS, HORIZONS, MODELS, horizon_label
from claimlens.operators.labels import readmission_labels

# Multiplier of the fixed score per model.
SCORE_FACTORS = dict(zip(MODELS, [37, 41, 43, 47], strict=False))


class Tables:
    """Claims tables over one folder of order tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @functools.cached_property
    def years(self) -> list[int]:
        """All years in which something was ordered. Runs a small aggregation."""
        bounds = self.read("orders").agg(F.min(F.year("o_orderdate")).alias("a"), F.max(F.year("o_orderdate")).alias("b")).first()
        return list(range(bounds.a, bounds.b + 1)) if bounds.a is not None else []

    @functools.cached_property
    def width(self) -> int:
        """The most lines of an order: that many code columns hold them all. Runs an aggregation."""
        lines = self.read("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
        return lines.agg(F.max("n")).first()[0] or 1

    def claims(self, codes: bool = False, stay: bool = False, side: str | None = None) -> DataFrame:
        """One claim per order, with the codes and the length of stay if asked for.

        ``side`` keeps one claim type by the order status itself, a filter the scan can use.
        """
        key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
        orders, inpatient = self.read("orders"), F.col("o_orderstatus").isin("F", "P")
        if side == "Inpatient":
            orders = orders.filter(inpatient)
        elif side == "Outpatient":
            orders = orders.filter(~inpatient | F.col("o_orderstatus").isNull())
        out = orders.select(
            key.alias("clm_id"),
            F.col("o_custkey").alias("desynpuf_id"),
            F.when(key % 499 != 0, day).alias("admit_date"),
            F.when(inpatient, "Inpatient").otherwise("Outpatient").alias("claim_type"),
            F.col("o_totalprice").cast("decimal(18,2)").alias("clm_pmt_amt"),
        )
        if stay:
            lines = self.read("lineitem").groupBy(F.col("l_orderkey").alias("clm_id")).agg(
                F.count("*").cast("int").alias("clm_utlztn_day_cnt")
            )
            days = F.coalesce("clm_utlztn_day_cnt", F.lit(0))
            out = out.join(lines, "clm_id", "left").withColumn("discharge_date", F.date_add("admit_date", days))
        if codes:
            out = out.join(self._codes(), "clm_id", "left")
        return out

    def _codes(self) -> DataFrame:
        """Brand of every line, one column each, and type of the first line per order."""
        order = Window.partitionBy("l_orderkey").orderBy(
            "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount"
        )
        first = (
            self.read("lineitem")
            .withColumn("k", F.row_number().over(order))
            .select("l_orderkey", "k", "l_partkey")
        )
        parts = self.read("part").select("p_partkey", "p_brand", "p_type")
        return (
            first.join(parts, first.l_partkey == parts.p_partkey, "left")
            .groupBy(F.col("l_orderkey").alias("clm_id"))
            .agg(
                *[F.max(F.when(F.col("k") == k, F.col("p_brand"))).alias(f"icd9_dgns_cd_{k}") for k in range(1, self.width + 1)],
                F.max(F.when(F.col("k") == 1, F.col("p_type"))).alias("icd9_prcdr_cd_1"),
            )
        )

    def inpatient(self, **options) -> DataFrame:
        return self.claims(side="Inpatient", **options)

    def raw_inpatient(self, **options) -> DataFrame:
        return self._raw(self.inpatient(stay=True, **options)).withColumnRenamed("_start", "clm_admsn_dt")

    def raw_outpatient(self, **options) -> DataFrame:
        return self._raw(self.claims(stay=True, side="Outpatient", **options)).withColumnRenamed("_start", "clm_from_dt").drop("clm_utlztn_day_cnt")

    @staticmethod
    def _raw(claims: DataFrame) -> DataFrame:
        """Claims as a file would hold them: yyyymmdd numbers, 0 for no date, n/a for some amounts."""

        def packed(name: str):
            d = F.col(name)
            return F.coalesce(F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d), F.lit(0))

        amount = F.when(F.col("clm_id") % 211 == 0, "n/a").otherwise(F.col("clm_pmt_amt").cast("string"))
        return claims.withColumns(
            {"_start": packed("admit_date"), "clm_thru_dt": packed("discharge_date"), "clm_pmt_amt": amount}
        ).drop("admit_date", "discharge_date", "claim_type")

    def labelled(self, **options) -> DataFrame:
        return readmission_labels(self.inpatient(**options))

    def beneficiaries(self, conditions: bool = True, money: bool = False) -> DataFrame:
        """One row per customer and year, with condition indicators and amounts if asked for."""
        key = F.col("c_custkey")
        person = self.read("customer").select(
            key.alias("desynpuf_id"),
            F.explode(F.array(*[F.lit(y) for y in self.years])).alias("year"),
            ((1920 + key % 60) * 10000 + (1 + key % 12) * 100 + (1 + key % 28)).cast("int").alias("bene_birth_dt"),
            (1 + key % 2).cast("string").alias("bene_sex_ident_cd"),
            F.col("c_mktsegment").alias("bene_race_cd"),
            F.col("c_nationkey").cast("int").alias("sp_state_code"),
            F.when(key % 14 == 0, "Y").otherwise("0").alias("bene_esrd_ind"),
            "c_acctbal",
        )
        key, year = F.col("desynpuf_id"), F.col("year")
        out = person.withColumns(
            {
                "bene_hi_cvrage_tot_mons": (key % 13).cast("int"),
                "bene_smi_cvrage_tot_mons": ((key + year) % 13).cast("int"),
                "bene_hmo_cvrage_tot_mons": (key % 7).cast("int"),
                "plan_cvrg_mos_num": ((key * 3) % 13).cast("int"),
            }
        )
        if conditions:
            indicators = {
                c: F.when(key % 97 != 0, F.coalesce(F.col(c), F.lit(2))) for c in CONDITIONS
            }
            out = out.join(self._conditions(), ["desynpuf_id", "year"], "left").withColumns(indicators)
        if money:
            paid = [F.coalesce(c, F.lit(0)).cast("decimal(18,2)").alias(c) for c in ("medreimb_ip", "medreimb_op")]
            nothing = F.lit(0).cast("decimal(18,2)")
            zeros = ["medreimb_car", "benres_op", "benres_car", "pppymt_ip", "pppymt_op", "pppymt_car"]
            out = out.join(self._payments(), ["desynpuf_id", "year"], "left").select(
                *[c for c in out.columns],
                *paid,
                F.col("c_acctbal").cast("decimal(18,2)").alias("benres_ip"),
                *[nothing.alias(c) for c in zeros],
            )
        return out.drop("c_acctbal")

    def _conditions(self) -> DataFrame:
        """1 per condition where the customer ordered a part of that condition's brand in the year."""
        orders = self.read("orders").select(
            "o_orderkey", F.col("o_custkey").alias("desynpuf_id"), F.year("o_orderdate").alias("year")
        )
        brands = [f"Brand#{i}" for i in range(1, len(CONDITIONS) + 1)]
        lines = self.read("lineitem").select("l_orderkey", "l_partkey")
        parts = self.read("part").select("p_partkey", "p_brand").filter(F.col("p_brand").isin(brands))
        return (
            lines.join(parts, lines.l_partkey == parts.p_partkey)
            .join(orders, lines.l_orderkey == orders.o_orderkey)
            .groupBy("desynpuf_id", "year")
            .agg(*[F.max(F.when(F.col("p_brand") == b, 1)).alias(c) for b, c in zip(brands, CONDITIONS, strict=True)])
        )

    def _payments(self) -> DataFrame:
        amount = F.col("clm_pmt_amt")
        inpatient = F.col("claim_type") == "Inpatient"
        return (
            self.claims()
            .filter(F.col("admit_date").isNotNull())
            .groupBy("desynpuf_id", F.year("admit_date").alias("year"))
            .agg(
                F.sum(F.when(inpatient, amount)).alias("medreimb_ip"),
                F.sum(F.when(~inpatient, amount)).alias("medreimb_op"),
            )
        )

    def person(self) -> DataFrame:
        return self.read("customer").select(
            F.col("c_custkey").alias("person_id"),
            F.col("c_name").alias("person_source_value"),
            F.when(F.col("c_custkey") % 2 == 0, "F").otherwise("M").alias("gender_source_value"),
            F.col("c_mktsegment").alias("race_source_value"),
        )

    def predictions(self) -> DataFrame:
        """The fixed score of every inpatient claim, per horizon and model."""
        targets = F.array(
            *[F.struct(F.lit(horizon_label(n)).alias("target"), F.col(horizon_label(n)).alias("label")) for n in HORIZONS]
        )
        names = F.array(
            *[F.struct(F.lit(m).alias("model"), F.lit(f).alias("factor")) for m, f in SCORE_FACTORS.items()]
        )
        base = ((F.col("clm_id") * F.col("factor") + 11) % 1000).cast("double")
        p = base * F.lit(0.8) / F.lit(1000.0) + F.lit(0.15) * F.col("label").cast("double") + F.lit(0.0005)
        return (
            self.labelled()
            .select("clm_id", "desynpuf_id", F.inline(targets))
            .select("*", F.inline(names))
            .select("target", "model", "clm_id", "desynpuf_id", "label", p.alias("p"))
        )
