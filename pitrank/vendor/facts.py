"""Public company-facts and submissions documents (nested JSON) to canonical fundamentals."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..functions.lineage import materialize
from ..schemas import FUNDAMENTAL_VALUES

ENTRY = T.StructType([T.StructField(n, t) for n, t in (
    ("start", T.StringType()), ("end", T.StringType()), ("val", T.StringType()), ("filed", T.StringType()),
    ("form", T.StringType()), ("fy", T.IntegerType()), ("fp", T.StringType()))])
FACTS_DOCUMENT = T.StructType([
    T.StructField("cik", T.LongType()),
    T.StructField("facts", T.MapType(T.StringType(), T.MapType(T.StringType(), T.StructType([
        T.StructField("units", T.MapType(T.StringType(), T.ArrayType(ENTRY)))]))))])
SUBMISSION_DOCUMENT = T.StructType([
    T.StructField("cik", T.LongType()), T.StructField("sic", T.StringType()),
    T.StructField("exchanges", T.ArrayType(T.StringType()))])

# Reporting tags per concept in order of priority, and exchange names.
FLOW_TAGS = {
    "revenue": ["Revenues", "RevenueFromContractWithCustomerExcludingAssessedTax", "SalesRevenueNet",
                "RevenuesNetOfInterestExpense"],
    "cogs": ["CostOfRevenue", "CostOfGoodsAndServicesSold", "CostOfGoodsSold"],
    "gross_profit": ["GrossProfit"],
    "ebit": ["OperatingIncomeLoss"],
    "net_income": ["NetIncomeLoss", "ProfitLoss"],
    "ocf": ["NetCashProvidedByUsedInOperatingActivities",
            "NetCashProvidedByUsedInOperatingActivitiesContinuingOperations"],
    "capex": ["PaymentsToAcquirePropertyPlantAndEquipment", "PaymentsToAcquireProductiveAssets"],
    "dividends": ["PaymentsOfDividends", "PaymentsOfDividendsCommonStock", "PaymentsOfOrdinaryDividends"],
    "shares_diluted": ["WeightedAverageNumberOfDilutedSharesOutstanding"],
}
INSTANT_TAGS = {
    "current_assets": ["AssetsCurrent"],
    "cash": ["CashAndCashEquivalentsAtCarryingValue", "CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents",
             "Cash"],
    "current_liabilities": ["LiabilitiesCurrent"],
    "short_term_debt": ["DebtCurrent", "LongTermDebtCurrent", "ShortTermBorrowings"],
    "long_term_debt": ["LongTermDebtNoncurrent", "LongTermDebt", "LongTermDebtAndCapitalLeaseObligations"],
    "net_ppe": ["PropertyPlantAndEquipmentNet"],
    "total_assets": ["Assets"],
    "book_equity": ["StockholdersEquity", "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest"],
    "preferred_stock": ["PreferredStockValue"],
    "minority_interest": ["MinorityInterest"],
}
SHARES_TAG = ("dei", "EntityCommonStockSharesOutstanding")
EXCHANGE_NAMES = {"nasdaq": "NASDAQ", "nyse": "NYSE", "nyse american": "AMEX", "nyse arca": "OTHER", "cboe": "OTHER",
                  "otc": "OTC"}
FLOW_COLUMN = {"revenue": "revenue_ttm", "gross_profit": "gross_profit_ttm", "ebit": "ebit_ttm",
               "net_income": "net_income_ttm", "ocf": "operating_cash_flow_ttm", "capex": "capex_ttm",
               "dividends": "dividends_ttm", "shares_diluted": "shares_diluted"}
ZERO_WHEN_MISSING = ("preferred_stock", "minority_interest", "short_term_debt")
LATE_DAYS = 45


CORRUPT = "_unreadable"


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """Facts documents, one per line. Those that cannot be read have NULL fields; :func:`read_documents` tells which."""
    return spark.read.schema(FACTS_DOCUMENT).json(path)


def read_submissions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SUBMISSION_DOCUMENT).json(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(file, document): the lines of document files as text, for :func:`sorted_out`."""
    return spark.read.text(path).select(F.input_file_name().alias("file"), F.col("value").alias("document"))


def parse_facts(documents: DataFrame, column: str = "document") -> DataFrame:
    """Documents held as text in a column."""
    return documents.select(F.from_json(column, FACTS_DOCUMENT).alias("_d")).select("_d.*")


def sorted_out(documents: DataFrame, schema: T.StructType, column: str = "document") -> tuple[DataFrame, DataFrame]:
    """(parsed, quarantine) of documents held as text: one pass each, nothing is dropped.

    A document is set aside with its ``problem``: ``empty`` (NULL or blank), ``broken`` (JSON that does not come to its end),
    ``mistyped`` (JSON, but a field has another type than the schema's), ``no_company`` (no cik). ``cik`` is read from
    the text where it can be. Text after a whole object is ignored. Quarantine keeps all columns of ``documents``; parsed rows have those of ``schema``.
    """
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    read = documents.withColumn("_d", F.from_json(column, full, {"columnNameOfCorruptRecord": CORRUPT}))
    text = F.col(column)
    # a document that nests to its end parses as a variant; that tells a wrong type from a broken text
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), F.lit(False))
    problem = (F.when(text.isNull() | (F.trim(text) == ""), "empty")
               .when(F.col(f"_d.{CORRUPT}").isNotNull() | F.col("_d").isNull(), F.when(is_object, "mistyped").otherwise("broken"))
               .when(F.col("_d.cik").isNull(), "no_company"))
    parsed = read.where(problem.isNull()).select(*[F.col(f"_d.{f}").alias(f) for f in schema.names])
    cik = F.regexp_extract(text, r'"cik"\s*:\s*"?(\d{1,18})', 1)
    aside = (read.where(problem.isNotNull())
             .select(*documents.columns, problem.alias("problem"), F.when(cik != "", cik.cast("long")).alias("cik")))
    return parsed, aside


def document_counts(quarantine: DataFrame) -> DataFrame:
    """(cik, n_empty, n_broken, n_mistyped, n_no_company): documents set aside, by the company they name."""
    return quarantine.groupBy("cik").agg(*[F.count_if(F.col("problem") == p).alias(f"n_{p}")
                                           for p in ("empty", "broken", "mistyped", "no_company")])


def unit_of(tag: Column) -> Column:
    return F.when(tag.isin(SHARES_TAG[1], *FLOW_TAGS["shares_diluted"]), "shares").otherwise("USD")


def flatten_facts(documents: DataFrame) -> DataFrame:
    """cik, taxonomy, tag, unit, start, end, val, filed: one row per reported value.

    Of several units the exact one is taken, else the first that starts with its name. Values that are not numbers
    and dates that cannot be read become NULL; rows without a value are dropped.
    """
    tags = (documents.select("cik", F.explode("facts").alias("taxonomy", "_tags"))
            .select("cik", "taxonomy", F.explode("_tags").alias("tag", "_v"))
            .withColumn("_unit", unit_of(F.col("tag")))
            .withColumn("_units", F.map_entries("_v.units")))
    chosen = F.coalesce(F.expr("get(filter(_units, u -> u.key = _unit), 0)"),
                        F.expr("get(filter(_units, u -> startswith(u.key, _unit)), 0)"))
    rows = (tags.withColumn("_c", chosen)
            .select("cik", "taxonomy", "tag", F.col("_c.key").alias("unit"), F.explode("_c.value").alias("_e")))
    return rows.select("cik", "taxonomy", "tag", "unit", F.try_to_date("_e.start").alias("start"),
                       F.try_to_date("_e.end").alias("end"), F.col("_e.val").try_cast("double").alias("val"),
                       F.try_to_date("_e.filed").alias("filed")).where(F.col("val").isNotNull())


def submissions_profile(documents: DataFrame) -> DataFrame:
    """cik, sic_code, exchange from submission documents."""
    raw = F.lower(F.coalesce(F.get("exchanges", F.lit(0)), F.lit("")))
    exchange = F.lit("OTHER")
    for name, label in EXCHANGE_NAMES.items():
        exchange = F.when(raw == name, label).otherwise(exchange)
    return documents.select("cik", F.coalesce(F.col("sic").try_cast("long"), F.lit(0)).alias("sic_code"),
                            exchange.alias("exchange"))


def _concept_table(spark: SparkSession) -> DataFrame:
    """Fixed-size lookup (tag -> concept, priority), a few dozen rows."""
    rows = [(tag, concept, i) for group in (FLOW_TAGS, INSTANT_TAGS) for concept, tags in group.items()
            for i, tag in enumerate(tags)]
    return spark.createDataFrame(rows, "tag string, concept string, priority int")


def concept_values(facts: DataFrame) -> DataFrame:
    """One value per (cik, concept, start, end): the tag with the best priority, of it the earliest filing.

    A partial aggregate, so a company with very many filings is reduced before it moves. A report without a filing
    date counts only where there is no dated one.
    """
    tagged = facts.where(F.col("taxonomy") == "us-gaap").join(F.broadcast(_concept_table(facts.sparkSession)), "tag")
    return (tagged.groupBy("cik", "concept", "start", "end")
            .agg(F.min(F.struct("priority", _dated_first("filed"), "val", "filed")).alias("_b"))
            .select("cik", "concept", "start", "end", "_b.val", "_b.filed"))


def _dated_first(filed: str) -> Column:
    """Sorts like the date, with missing dates last."""
    return F.coalesce(F.col(filed), F.lit("9999-12-31").cast("date")).alias("_at")


def first_reported(df: DataFrame, keys: list[str], value: str = "val") -> DataFrame:
    return (df.groupBy(*keys).agg(F.min(F.struct(_dated_first("filed"), value, "filed")).alias("_b"))
            .select(*keys, F.col(f"_b.{value}").alias(value), "_b.filed"))


BUCKET_DAYS, TOLERANCE = 25, 12


def ttm_from_durations(values: DataFrame) -> DataFrame:
    """cik, concept, end, ttm, filed (and the filing date of the year-ago piece) from values with a start date.

    A year-end value is the annual one. In between: last annual + year-to-date - year-to-date a year earlier. The
    annual value comes from an ordered window; the year-ago value may be off by some days, so both sides meet in
    date buckets instead of all pairs of a company.
    """
    key = ["cik", "concept"]
    d = values.where(F.col("start").isNotNull()).withColumn("days", F.datediff("end", "start"))
    annual = (d.where(F.col("days").between(350, 380)).groupBy(*key, "end")
              .agg(F.min(F.struct(_dated_first("filed"), "days", "val", "filed")).alias("a")))
    ytd = (d.where(F.col("days").between(60, 300)).groupBy(*key, "end")
           .agg(F.max(F.struct("days", (-F.unix_date(_dated_first("filed"))).alias("_f"), "val", "filed")).alias("y")))
    both = annual.join(ytd, [*key, "end"], "full_outer").withColumn("_n", F.unix_date("end"))
    before = Window.partitionBy(*key).orderBy("_n").rangeBetween(Window.unboundedPreceding, -1)
    with_prev = both.withColumn("p", F.last(F.when(F.col("a").isNotNull(), F.struct(
        F.col("_n").alias("n"), F.col("a.val").alias("val"), F.col("a.filed").alias("filed"))), ignorenulls=True).over(before))
    target = F.unix_date(F.add_months("end", -12))
    probes = (with_prev.where(F.col("a").isNull() & F.col("y").isNotNull() & (F.col("_n") - F.col("p.n") <= 300))
              .select(*key, "end", F.col("y.days").alias("days"), F.col("y.val").alias("val"), F.col("y.filed").alias("filed"),
                      F.col("p.val").alias("annual_val"), F.col("p.filed").alias("annual_filed"), target.alias("_t"))
              .withColumn("_bucket", F.explode(F.sequence(F.floor((F.col("_t") - TOLERANCE) / BUCKET_DAYS),
                                                          F.floor((F.col("_t") + TOLERANCE) / BUCKET_DAYS)))))
    earlier = ytd.select(*key, F.unix_date("end").alias("_pn"), F.col("y.days").alias("_pdays"), F.col("y.val").alias("_pval"),
                         F.col("y.filed").alias("_pfiled")).withColumn("_bucket", F.floor(F.col("_pn") / BUCKET_DAYS))
    matched = (probes.join(earlier, [*key, "_bucket"])
               .where((F.abs(F.col("_pn") - F.col("_t")) <= TOLERANCE) & (F.abs(F.col("_pdays") - F.col("days")) <= TOLERANCE)))
    interim = (matched.groupBy(*key, "end", "val", "filed", "annual_val", "annual_filed")
               .agg(F.min(F.struct(_dated_first("_pfiled"), "_pn", "_pval", "_pfiled")).alias("_p"))
               .select(*key, "end", (F.col("annual_val") + F.col("val") - F.col("_p._pval")).alias("ttm"),
                       F.greatest("filed", "annual_filed").alias("filed"), F.col("_p._pfiled").alias("prior_filed")))
    yearly = annual.select(*key, "end", F.col("a.val").alias("ttm"), F.col("a.filed").alias("filed"),
                           F.lit(None).cast("date").alias("prior_filed"))
    return yearly.unionByName(interim)


def instants(values: DataFrame) -> DataFrame:
    return first_reported(values.where(F.col("start").isNull()), ["cik", "concept", "end"])


def shares_history(facts: DataFrame) -> DataFrame:
    """Share counts from the cover page as first reported: cik, end, val, filed."""
    return first_reported(facts.where((F.col("taxonomy") == SHARES_TAG[0]) & (F.col("tag") == SHARES_TAG[1])), ["cik", "end"])


def company_fundamentals(facts: DataFrame) -> DataFrame:
    """Canonical fundamentals per company and period end, at ends with both total assets and revenue.

    Gross profit falls back to revenue less cost only for companies that never report it. A row is available when
    the last of its pieces was filed; a filing date before the period end becomes the period end plus 45 days.
    ``shares_diluted`` is a four-quarter figure built like the flows, as in the source data. Reports without a filing
    date were never seen to be public, so they are left out.
    """
    # read five times below; the nested text is parsed once
    values = materialize(concept_values(facts.where(F.col("filed").isNotNull())))
    flows = (ttm_from_durations(values.where(F.col("concept").isin(*FLOW_TAGS)))
             .select("cik", "concept", "end", F.col("ttm").alias("x"), "filed"))
    points = (instants(values.where(F.col("concept").isin(*INSTANT_TAGS)))
              .select("cik", "concept", "end", F.col("val").alias("x"), "filed"))
    concepts = [*FLOW_TAGS, *INSTANT_TAGS]
    wide = flows.unionByName(points).groupBy("cik", "end").agg(
        *[F.max(F.when(F.col("concept") == c, F.col("x"))).alias(c) for c in concepts],
        F.max(F.when(F.col("concept") != "cogs", F.col("filed"))).alias("_filed"))
    per_company = Window.partitionBy("cik")
    wide = wide.withColumn("_reports_gross", F.max(F.col("gross_profit").isNotNull()).over(per_company))
    gross = F.when(F.col("_reports_gross"), F.col("gross_profit")).otherwise(F.col("revenue") - F.col("cogs"))
    out = wide.withColumn("gross_profit", gross).where(F.col("total_assets").isNotNull() & F.col("revenue").isNotNull())
    columns = {FLOW_COLUMN.get(c, c): (F.coalesce(c, F.lit(0.0)) if c in ZERO_WHEN_MISSING else F.col(c))
               for c in concepts if c != "cogs"}
    available = F.when(F.col("_filed") >= F.col("end"), F.col("_filed")).otherwise(F.date_add("end", LATE_DAYS))
    return out.select(F.col("cik").cast("string").alias("security_id"), F.col("end").alias("fiscal_period_end"),
                      available.alias("available_date"), *[columns[c].alias(c) for c in FUNDAMENTAL_VALUES])


def late_prior_values(ttm: DataFrame) -> DataFrame:
    """Audit: interim values whose year-ago figure was filed after the date they are stated to be public from."""
    return ttm.groupBy("concept").agg(F.count("prior_filed").alias("n_interim"),
                                      F.count_if(F.col("prior_filed") > F.col("filed")).alias("n_late"))
