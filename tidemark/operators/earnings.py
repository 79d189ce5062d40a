"""Filings, estimates and their point-in-time combination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.clock import RELEASE_MINUTES, local_instant
from tidemark.operators.asof import asof
from tidemark.schema import ratio

# Concepts per metric in order of preference, units, forms, quarters.
CONCEPTS = {
    "revenue": ("RevenueFromContractWithCustomerExcludingAssessedTax", "Revenues", "SalesRevenueNet"),
    "net_income": ("NetIncomeLoss", "ProfitLoss"),
    "eps_actual_sec": ("EarningsPerShareDiluted", "EarningsPerShareBasic"),
    "assets": ("Assets",), "liabilities": ("Liabilities",),
    "equity": ("StockholdersEquity", "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest"),
    "cash_flow": ("NetCashProvidedByUsedInOperatingActivities",),
}
INSTANTS = ("assets", "liabilities", "equity")
FLOWS = ("revenue", "net_income", "cash_flow")
FORMS = ("10-Q", "10-Q/A", "10-K", "10-K/A")
PER_SHARE_UNITS = ("usd/shares", "usd-per-shares", "usd/share")
QUARTERS = {"Q1": 1, "Q2": 2, "Q3": 3, "FY": 4, "Q4": 4}
QUARTER_DAYS, YEAR_DAYS, DIRECT_LOW, DIRECT_HIGH = 91, 365, 60, 130
POOR_UNIT = 5
MATCH_BEFORE, MATCH_AFTER, MATCH_FILING = 7, 190, 45
FACT = "struct<start:string,end:string,val:double,accn:string,fy:int,fp:string,form:string,filed:string,frame:string>"
FACTS_JSON = f"struct<facts:struct<`us-gaap`:map<string,struct<units:map<string,array<{FACT}>>>>>>"
SUBMISSIONS_JSON = ("struct<filings:struct<recent:struct<accessionNumber:array<string>,acceptanceDateTime:array<string>,"
                    "filingDate:array<string>,reportDate:array<string>,form:array<string>>>>")


def quarter_number(fp: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in QUARTERS.items() for x in kv]), fp)


def explode_facts(companies: DataFrame, *, keys: list[str], json: str) -> DataFrame:
    """One row per usable fact with its metric and the ranks of concept and unit."""
    named = F.create_map(*[x for metric, concepts in CONCEPTS.items() for rank, concept in enumerate(concepts) for x in (
        F.lit(concept), F.struct(F.lit(metric).alias("metric"), F.lit(rank).alias("concept_rank")))])
    d = companies.select(*keys, F.explode(F.from_json(json, FACTS_JSON)["facts"]["us-gaap"]).alias("concept", "_c"))
    d = d.withColumn("_n", F.try_element_at(named, F.col("concept"))).filter(F.col("_n").isNotNull())
    d = d.select(*keys, "concept", "_n.*", F.explode("_c.units").alias("unit", "_f")).select(
        *keys, "concept", "metric", "concept_rank", "unit", F.inline("_f"))
    unit = F.replace(F.lower("unit"), F.lit(" "), F.lit(""))
    good = F.when(F.col("metric") == "eps_actual_sec", unit.isin(*PER_SHARE_UNITS)).otherwise(unit == "usd")
    start, end = F.try_to_date("start"), F.try_to_date("end")
    return d.filter(F.col("form").isin(*FORMS) & F.col("val").isNotNull() & ~F.isnan("val") & F.col("accn").isNotNull()).select(
        *keys, "metric", "concept", "concept_rank", "unit", F.when(good, 0).otherwise(POOR_UNIT).alias("unit_rank"),
        start.alias("start"), end.alias("end"), (F.datediff(end, start) + 1).alias("period_days"), F.col("val").alias("value"),
        "accn", "fy", "fp", "form", F.try_to_date("filed").alias("filed"), F.upper(F.coalesce("frame", F.lit(""))).alias("frame"))


def acceptance_clock(submissions: DataFrame, *, keys: list[str], json: str) -> DataFrame:
    """Accession, acceptance instant, filing and report dates from parallel arrays."""
    r = F.from_json(json, SUBMISSIONS_JSON)["filings"]["recent"]
    rows = F.arrays_zip(r["accessionNumber"].alias("accn"), r["acceptanceDateTime"].alias("accepted"), r["filingDate"].alias("filing_date"),
                        r["reportDate"].alias("report_date"), r["form"].alias("form"))
    return submissions.select(*keys, F.inline(rows)).filter(F.col("accn") != "").select(
        *keys, "accn", F.try_to_timestamp("accepted").alias("accepted"), F.try_to_date("filing_date").alias("filing_date"),
        F.try_to_date("report_date").alias("report_date"), "form")


def filing_available(accepted: Column, filed: Column) -> Column:
    """Acceptance instant, else midnight UTC after the filing date."""
    return F.coalesce(accepted, F.date_add(filed, 1).cast("timestamp"))


def majority_period(facts: DataFrame, *, keys: list[str]) -> DataFrame:
    """Fiscal period and year most facts of an accession state; ties take the smaller."""
    return facts.groupBy(*keys, "accn").agg(
        F.mode("fp", deterministic=True).alias("fp"), F.mode("fy", deterministic=True).alias("fy"),
        F.min("filed").alias("filed"), F.max("end").alias("period_end"), F.count(F.lit(1)).alias("facts"))


def pick_facts(facts: DataFrame, filings: DataFrame, *, keys: list[str]) -> DataFrame:
    """The best fact per accession and metric: duration and end-date fit, then unit,
    then concept.  ``filings`` gives fp and period_end per accession."""
    d = facts.drop("fp", "fy", "filed").join(filings.select(*keys, "accn", "fp", "fy", "filed", "period_end"), [*keys, "accn"])
    apart = F.coalesce(F.abs(F.datediff("end", "period_end")).cast("double"), F.lit(1e9))
    days = F.coalesce(F.col("period_days").cast("double"), F.lit(9999.0))
    direct = days.between(DIRECT_LOW, DIRECT_HIGH)
    annual = F.when(direct & F.col("frame").rlike("Q4$"), F.abs(days - QUARTER_DAYS) - 1000).otherwise(F.abs(days - YEAR_DAYS))
    within = F.when(direct, F.abs(days - QUARTER_DAYS)).otherwise(
        F.abs(days - QUARTER_DAYS * F.coalesce(quarter_number(F.col("fp")), F.lit(1))) + 100)
    duration = F.when(F.col("fp") == "FY", annual).otherwise(within)
    score = F.when(F.col("metric").isin(*INSTANTS), apart).otherwise(duration + F.least(apart, F.lit(1000.0)) * 10)
    fact = F.struct("value", "period_days", "concept", "unit")
    order = F.struct(score.alias("s"), "unit_rank", "concept_rank", F.col("start").isNotNull().alias("dated"), "concept", "unit", "start", "end", "value")
    return d.groupBy(*keys, "accn", "fp", "fy", "filed", "period_end", "metric").agg(F.min_by(fact, order).alias("_f")).select(
        *keys, "accn", "fp", "fy", "filed", "period_end", "metric", "_f.*")


def derive_liabilities(picked: DataFrame, *, keys: list[str]) -> DataFrame:
    """Metrics of a filing side by side; missing liabilities are assets minus equity."""
    wide = picked.groupBy(*keys, "accn", "fp", "fy", "filed", "period_end").agg(
        *[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in CONCEPTS])
    return wide.withColumn("liabilities", F.coalesce("liabilities", F.col("assets") - F.col("equity")))


def quarterise(picked: DataFrame, *, keys: list[str]) -> DataFrame:
    """Year-to-date flows turned into quarters: Q2 and Q3 minus earlier quarters, Q4 as
    the year minus three quarters or nothing.  Per-share values are never subtracted.

    The filings of one company, year and metric (a handful) are folded in one array,
    quarter by quarter, because a later quarter uses the derived earlier ones.
    """
    d = picked.filter(F.col("metric").isin(*FLOWS, "eps_actual_sec")).withColumn("q", quarter_number(F.col("fp")))
    row = F.struct("q", "filed", "accn", "fp", "period_end", F.col("value").alias("raw"), F.col("value").alias("value"), "period_days",
                   F.lit("reported_quarter").alias("derivation"))
    g = d.groupBy(*keys, "fy", "metric").agg(F.array_sort(F.collect_list(row)).alias("_a"))
    g = g.withColumn("_a0", F.col("_a"))
    for step in (2, 3, 4):
        g = g.withColumn(f"_a{step - 1}", _step(F.col(f"_a{step - 2}"), step))
    out = g.select(*keys, "fy", "metric", F.inline("_a3"))
    eps = F.col("metric") == "eps_actual_sec"
    bad = eps & (F.col("period_days").isNull() | (F.col("period_days") > DIRECT_HIGH))
    return out.withColumns({"value": F.when(bad, F.lit(None)).otherwise(F.when(eps, F.col("raw")).otherwise(F.col("value"))),
                            "derivation": F.when(bad, "non_additive_period_rejected").when(eps, "reported_quarter").otherwise(F.col("derivation"))})


def _step(rows: Column, quarter: int) -> Column:
    def fix(r):
        def prior(n):
            seen = F.filter(rows, lambda p: (p["q"] == n) & (p["filed"].isNull() | r["filed"].isNull() | (p["filed"] <= r["filed"])))
            newest = F.array_max(F.transform(seen, lambda p: F.struct(p["filed"].alias("filed"), p["accn"].alias("accn"), p["value"].alias("value"))))
            return newest["value"]
        parts = [prior(n) for n in range(1, quarter)]
        rest = r["raw"]
        for p in parts:
            rest = rest - p  # null when any earlier quarter is missing
        direct = F.coalesce(r["period_days"] <= DIRECT_HIGH, F.lit(False))
        due = (r["q"] == quarter) & ~direct
        value = F.when(due, rest if quarter == 4 else F.coalesce(rest, r["value"])).otherwise(r["value"])
        label = F.when(due & rest.isNotNull(), "derived_q4_from_annual" if quarter == 4 else "quarterized_ytd")
        if quarter == 4:
            label = label.when(due, "q4_not_derivable")
        keep = [r[c].alias(c) for c in ("q", "filed", "accn", "fp", "period_end", "raw")]
        return F.struct(*keep, value.alias("value"), r["period_days"].alias("period_days"), label.otherwise(r["derivation"]).alias("derivation"))
    return F.transform(rows, fix)


# ------------------------------------------------------------------ estimates
# Release label spellings.
RELEASE_LABELS = {
    "bmo": "before_market_open", "before_market_open": "before_market_open", "amc": "after_market_close",
    "after_market_close": "after_market_close", "dmh": "during_market_hours", "during_market_hours": "during_market_hours",
}


def release_label(raw: Column) -> Column:
    low = F.replace(F.lower(F.trim(F.coalesce(raw, F.lit("")))), F.lit(" "), F.lit("_"))
    known = F.try_element_at(F.create_map(*[F.lit(x) for kv in RELEASE_LABELS.items() for x in kv]), low)
    return F.coalesce(known, F.when(low.rlike(r"^\d{1,2}:\d{2}(:\d{2})?$"), low), F.lit("unknown"))


def event_clock(day: Column, label: Column) -> Column:
    """Instant results are out; without a reliable time the next UTC midnight."""
    clock = F.split(label, ":")
    minute = (F.when(label == "before_market_open", RELEASE_MINUTES["bmo"]).when(label == "after_market_close", RELEASE_MINUTES["amc"])
              .when(label == "during_market_hours", RELEASE_MINUTES["dmh"])
              .otherwise(F.try_element_at(clock, F.lit(1)).try_cast("int") * 60 + F.try_element_at(clock, F.lit(2)).try_cast("int")))
    return F.when(label == "unknown", F.date_add(day, 1).cast("timestamp")).otherwise(local_instant(day, minute))


def estimate_cutoff(day: Column, label: Column) -> Column:
    """Last safe instant for a pre-event estimate; unknown time: start of the day."""
    return F.when(label == "unknown", day.cast("timestamp")).otherwise(event_clock(day, label))


def select_estimates(history: DataFrame, *, keys: list[str], observed: str = "observed_at", extra: list[str] | None = None) -> DataFrame:
    """One row per event: the last estimate seen before it, the first actual seen, and
    whether the estimate is safe.  Needs estimate/actual columns and ``cutoff``."""
    at = F.col(observed)
    some = F.col("eps_estimated").isNotNull() | F.col("revenue_estimated").isNotNull()
    done = F.col("eps_actual").isNotNull() | F.col("revenue_actual").isNotNull()
    before = some & (at <= F.col("cutoff"))
    est = F.struct(at.alias("at"), "eps_estimated", "revenue_estimated")
    act = F.struct(at.alias("at"), "eps_actual", "revenue_actual")
    g = history.groupBy(*keys).agg(
        F.max_by(F.when(before, est), F.when(before, at)).alias("_pre"), F.min_by(F.when(some, est), F.when(some, at)).alias("_any"),
        F.min_by(est, at).alias("_first"), F.min_by(F.when(done, act), F.when(done, at)).alias("_act"), F.max_by(act, at).alias("_last"),
        F.min(at).alias("event_schedule_available"), *[F.any_value(c).alias(c) for c in (extra or [])])
    chosen, actual = F.coalesce("_pre", "_any", "_first"), F.coalesce("_act", "_last")
    return g.select(
        *keys, *(extra or []), chosen["eps_estimated"].alias("eps_estimated"), chosen["revenue_estimated"].alias("revenue_estimated"),
        actual["eps_actual"].alias("eps_actual"), actual["revenue_actual"].alias("revenue_actual"),
        chosen["at"].alias("estimate_available"), "event_schedule_available", F.col("_act.at").alias("actual_available"),
        F.col("_pre").isNotNull().alias("estimate_safe"),
        F.when(F.col("_pre").isNotNull(), "observed_pre_event").when(F.col("_any").isNotNull(), "backfill_unverified")
         .otherwise("estimate_missing").alias("estimate_status"))


def match_filings(filings: DataFrame, events: DataFrame, *, keys: list[str], filing_id: str, event_id: str) -> DataFrame:
    """Each filing with its best estimate event, plus the events no filing took.

    An exact fiscal-end match wins (latest event).  Otherwise the event must lie
    around the period end and near the filing; the range condition is an equality
    join on 45-day slots of the two dates, so pairs stay near-linear.
    """
    f = filings.select(*keys, filing_id, "period_end", "filing_date")
    e = events.select(*keys, F.col(event_id), "earnings_date", "fiscal_end")
    exact = f.join(e, (F.col("period_end") == F.col("fiscal_end")) & _same(f, e, keys)).select(
        f[filing_id], e[event_id], F.lit(0).alias("_kind"), (-F.unix_date("earnings_date")).cast("long").alias("_score"), "earnings_date")
    slot = lambda c: F.floor(F.unix_date(c) / MATCH_FILING)
    fs = f.withColumn("_slot", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda s: slot("filing_date") + s)))
    es = e.withColumn("_slot", slot("earnings_date"))
    ahead = F.datediff("earnings_date", "period_end")
    near = F.abs(F.datediff("earnings_date", "filing_date"))
    close = fs.join(es, [*keys, "_slot"]).filter(ahead.between(-MATCH_BEFORE, MATCH_AFTER) & (near <= MATCH_FILING)).select(
        filing_id, event_id, F.lit(1).alias("_kind"), (near * 10 + F.abs(ahead)).cast("long").alias("_score"), "earnings_date")
    best = exact.unionByName(close).groupBy(filing_id).agg(
        F.min_by(F.struct(event_id, "_kind"), F.struct("_kind", "_score", "earnings_date", event_id)).alias("_b"))
    joined = filings.join(best, filing_id, "left").select(
        *filings.columns, F.col(f"_b.{event_id}").alias(event_id),
        F.when(F.col("_b").isNull(), "sec_only").when(F.col("_b._kind") == 0, "fiscal_period_end").otherwise("nearest_filing_and_period").alias("match_method"))
    taken = joined.select(event_id).filter(F.col(event_id).isNotNull()).distinct()
    rest = events.join(taken, event_id, "left_anti").select(*keys, event_id, F.lit("fmp_only").alias("match_method"))
    return joined.unionByName(rest, allowMissingColumns=True)


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & (a[k] == b[k])
    return out


def surprise(actual: Column, estimate: Column) -> tuple[Column, Column]:
    gap = actual - estimate
    return gap, ratio(gap, F.abs(estimate)) * 100


def combine(matched: DataFrame, *, keys: list[str], tie: list[str] | None = None) -> DataFrame:
    """Filing values preferred to vendor values, surprises, clocks, id and revision.

    Needs ``eps_actual_sec``, ``revenue_sec``, ``eps_actual_vendor``, ``revenue_vendor``,
    estimates and the source clocks.
    """
    d = matched.withColumns({
        "eps_actual": F.coalesce("eps_actual_sec", "eps_actual_vendor"), "revenue_actual": F.coalesce("revenue_sec", "revenue_vendor"),
        "actual_source_eps": F.when(F.col("eps_actual_sec").isNotNull(), "SEC").when(F.col("eps_actual_vendor").isNotNull(), "FMP"),
        "actual_source_revenue": F.when(F.col("revenue_sec").isNotNull(), "SEC").when(F.col("revenue_vendor").isNotNull(), "FMP")})
    clock = lambda source: F.when(F.col(source) == "SEC", F.col("sec_available")).otherwise(F.col("vendor_actual_available"))
    eps, eps_pct = surprise(F.col("eps_actual"), F.col("eps_estimated"))
    rev, rev_pct = surprise(F.col("revenue_actual"), F.col("revenue_estimated"))
    d = d.withColumns({"eps_surprise": eps, "eps_surprise_pct": eps_pct, "revenue_surprise": rev, "revenue_surprise_pct": rev_pct,
                       "actual_available": F.greatest(clock("actual_source_eps"), clock("actual_source_revenue")),
                       "date": F.coalesce("earnings_date", "filing_date")})
    # greatest() skips missing clocks, which is what "latest of those known" means.
    d = d.withColumns({"surprise_available": F.greatest("actual_available", "estimate_available"),
                       "record_available": F.greatest("sec_available", "estimate_available", "actual_available", "event_schedule_available"),
                       "event_id": F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.when(
                           F.col("fiscal_year").isNotNull() & F.col("fiscal_quarter").isNotNull(),
                           F.concat(F.lit("FY"), F.col("fiscal_year").cast("string"), F.lit("|"), F.col("fiscal_quarter")))
                           .otherwise(F.date_format("date", "yyyy-MM-dd")))})
    w = Window.partitionBy("event_id").orderBy(F.col("record_available").asc_nulls_last(), F.col("filing_date").asc_nulls_last(),
                                                *[F.col(c).asc_nulls_last() for c in (tie or [])])
    return d.withColumn("revision_number", F.row_number().over(w))


# -------------------------------------------------------- point-in-time features
PIT_FEATURES = (
    "days_to_earnings", "days_since_earnings", "earnings_event_today", "earnings_time_bmo", "earnings_time_amc", "eps_estimated",
    "eps_actual", "eps_surprise", "eps_surprise_pct", "revenue_estimated", "revenue_actual", "revenue_surprise", "revenue_surprise_pct",
    "net_income", "assets", "liabilities", "cash_flow", "earnings_point_in_time_safe", "earnings_data_age_days")
_RECORD = ("event_id", "earnings_date", "earnings_time", "filing_date", "event_schedule_available", "estimate_available", "actual_available",
           "surprise_available", "sec_available", "estimate_safe", "eps_estimated", "revenue_estimated", "eps_actual", "revenue_actual",
           "eps_surprise", "eps_surprise_pct", "revenue_surprise", "revenue_surprise_pct", "net_income", "assets", "liabilities", "cash_flow", "tie")


def change_points(records: DataFrame, *, keys: list[str]) -> DataFrame:
    """What is known about a ticker's earnings, at every instant it changes.

    A record takes effect once, at its clock or at the UTC midnight its report date begins,
    so facts, actual and surprise are running maxima along the change points: work in
    proportion to the records, however many a ticker has.  The next and last report date
    also lose listings.  A report listed several times counts as its earliest listing known
    so far: ``_m`` is when an earlier one of the same report appears, and a listing that
    appears no sooner than that never counts.  Only those that do (the reports of a ticker,
    four a year, and their new dates) are compared with each other, where one comes or goes.
    """
    known = F.when(F.col("earnings_date").isNotNull(), F.col("event_schedule_available"))
    earlier = Window.partitionBy(*keys, "event_id").orderBy("earnings_date", "event_schedule_available", F.struct(*_RECORD)).rowsBetween(Window.unboundedPreceding, -1)
    # One shuffle: all that follows is by ticker, or by more than the ticker.
    g = records.repartition(*keys).withColumn("_m", F.min(known).over(earlier)).groupBy(*keys).agg(F.collect_list(F.struct(
        F.col("earnings_date").alias("d"), F.col("event_schedule_available").alias("s"), F.struct(*_RECORD).alias("r"), F.col("_m").alias("m"))).alias("_a"))
    g = g.withColumn("_live", F.array_sort(F.filter("_a", lambda x: x["d"].isNotNull() & x["s"].isNotNull() & (x["m"].isNull() | (x["m"] > x["s"])))))
    bounds = F.flatten(F.transform("_live", lambda x: F.array(x["s"].cast("timestamp"), x["m"].cast("timestamp"), x["d"].cast("timestamp"), F.date_add(x["d"], 1).cast("timestamp"))))

    def move(t, kind, r, last=None):
        return F.struct(t.cast("timestamp").alias("t"), F.lit(kind).alias("_kind"), r.alias("_r"), (F.lit(None) if last is None else last).cast("date").alias("_last"))

    def schedule(t):
        today = t.cast("date")
        once = F.filter("_live", lambda x: (x["s"] <= t) & (x["m"].isNull() | (x["m"] > t)))
        return move(t, 3, F.try_element_at(F.filter(once, lambda x: x["d"] >= today), F.lit(1))["r"], F.try_element_at(F.filter(once, lambda x: x["d"] <= today), F.lit(-1))["d"])

    def past(clock):
        return lambda x: F.when(x["d"].isNotNull() & x["r"][clock].isNotNull(), F.greatest(x["r"][clock], x["d"].cast("timestamp")))
    actual, surprise = past("actual_available"), past("surprise_available")
    moves = F.concat(F.transform("_a", lambda x: move(x["r"]["sec_available"], 0, x["r"])), F.transform("_a", lambda x: move(actual(x), 1, x["r"])),
                     F.transform(F.filter("_a", lambda x: x["r"]["estimate_safe"]), lambda x: move(surprise(x), 2, x["r"])),
                     F.transform(F.array_distinct(F.array_compact(bounds)), schedule))
    newest = lambda kind, *order: F.max(F.when(F.col("_kind") == kind, F.struct(
        *[F.col(f"_r.{o}").alias(f"o{n}") for n, o in enumerate((*order, "tie"))], "_r")))
    points = g.select(*keys, F.inline(moves)).filter(F.col("t").isNotNull()).groupBy(*keys, "t").agg(
        F.max(F.when(F.col("_kind") == 3, F.struct("_r", "_last"))).alias("_plan"), newest(0, "sec_available", "filing_date").alias("facts"),
        newest(1, "earnings_date", "actual_available").alias("actual"), newest(2, "earnings_date", "surprise_available").alias("surprise"))
    upto = Window.partitionBy(*keys).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    points = points.withColumns({"_plan": F.last("_plan", ignorenulls=True).over(upto), **{c: F.max(c).over(upto) for c in ("facts", "actual", "surprise")}})
    return points.select(*keys, "t", F.col("_plan._r").alias("next"), F.col("_plan._last").alias("last_date"), *[F.col(f"{c}._r").alias(c) for c in ("facts", "actual", "surprise")])


PIT_STATE = ("next", "last_date", "facts", "actual", "surprise")


def feature_points(records: DataFrame, *, keys: list[str], tie: str | None = None) -> DataFrame:
    """(keys, t, state): the change points as a source for an as-of join; ``PIT_STATE`` names the state."""
    tied = F.coalesce(F.col(tie).cast("long"), F.lit(-1).cast("long")) if tie else F.lit(0).cast("long")
    return change_points(records.withColumn("tie", tied), keys=keys)


def attach_features(rows: DataFrame, records: DataFrame, *, keys: list[str], ts: str, tie: str | None = None,
                    bucket_seconds: int = 7 * 86_400) -> DataFrame:
    """The nineteen features at every row, each behind its own availability clock."""
    points = feature_points(records, keys=keys, tie=tie)
    d = asof(rows, points, keys=keys, left_time=ts, right_time="t", take=list(PIT_STATE), bucket_seconds=bucket_seconds)
    return feature_columns(d, ts=ts)


def feature_columns(d: DataFrame, *, ts: str) -> DataFrame:
    """The nineteen features of rows that carry the state known at ``ts``; the state goes."""
    today = F.to_date(ts)
    nxt, sur, act, facts = F.col("next"), F.col("surprise"), F.col("actual"), F.col("facts")
    safe_next = F.coalesce((nxt["estimate_available"] <= F.col(ts)) & nxt["estimate_safe"], F.lit(False))
    hit = sur.isNotNull()
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    of = lambda name, other: F.when(hit, sur[name]).otherwise(other)
    none = F.lit(None).cast("double")
    out = {
        "days_to_earnings": F.datediff(nxt["earnings_date"], today).cast("double"), "days_since_earnings": F.datediff(today, F.col("last_date")).cast("double"),
        "earnings_event_today": flag(nxt["earnings_date"] == today), "earnings_time_bmo": flag(nxt["earnings_time"] == "before_market_open"),
        "earnings_time_amc": flag(nxt["earnings_time"] == "after_market_close"),
        "eps_estimated": of("eps_estimated", F.when(safe_next, nxt["eps_estimated"])), "eps_actual": of("eps_actual", act["eps_actual"]),
        "eps_surprise": of("eps_surprise", none), "eps_surprise_pct": of("eps_surprise_pct", none),
        "revenue_estimated": of("revenue_estimated", F.when(safe_next, nxt["revenue_estimated"])), "revenue_actual": of("revenue_actual", act["revenue_actual"]),
        "revenue_surprise": of("revenue_surprise", none), "revenue_surprise_pct": of("revenue_surprise_pct", none),
        "net_income": facts["net_income"], "assets": facts["assets"], "liabilities": facts["liabilities"], "cash_flow": facts["cash_flow"],
        "earnings_point_in_time_safe": F.when(hit, 1.0).otherwise(safe_next.cast("double")),
        "earnings_data_age_days": F.when(hit, (F.unix_micros(ts) - F.unix_micros(sur["surprise_available"])) / 86_400e6),
    }
    return d.select(*[c for c in d.columns if c not in PIT_STATE], *[c.alias(n) for n, c in out.items()])
