"""Nightly batch rules over accounts, transactions and loans, as set-based jobs for one date.

Money columns are decimals; dates are passed in. A rule for a day reads that day by a range on
the raw time column, so the scan skips all other days.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window as W, functions as F

CREDITS = ("DEPOSIT", "CLEARING_CR")
DEBITS = ("CARD", "CLEARING_DR")
CASH, RECEIVABLE, DEPOSITS, SUSPENSE = "1010", "1210", "2010", "9999"
LOAN_INCOME, FEE_INCOME, INTEREST_EXPENSE = "4010", "4020", "5010"


def _zero(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(0))


def on_day(when: str, date: dt.date) -> Column:
    start = F.lit(date)
    return (F.col(when) >= start) & (F.col(when) < F.date_add(start, 1))


def unless_done(rows: DataFrame, done: DataFrame, date: dt.date) -> DataFrame:
    """Nothing when ``done`` already has rows of that business date, else ``rows``."""
    already = done.filter(F.col("business_date") == F.lit(date)).agg(F.count(F.lit(1)).alias("n")).scalar()
    return rows.withColumn("business_date", F.lit(date)).filter(already == 0)


# ------------------------------------------------------------------ interest and fees


def daily_interest(amount: Column, rate_pct: Column) -> Column:
    """One day of ACT/365 interest on an amount."""
    return F.round(amount * rate_pct / F.lit(36500), 4)


def accrue_interest(loans: DataFrame, accounts: DataFrame, *, savings_rate: float, date: dt.date) -> DataFrame:
    """Accrual rows for open loans and active savings.

    Non-performing loans and loans without a usable rate are kept at zero, the latter with a warning.
    """
    rate, status = F.col("rate_pct"), F.col("status")
    unusable = rate.isNull() | (rate <= 0)
    open_loans = loans.filter((status != "CLOSED") & (_zero("outstanding") > 0))
    loan_rows = open_loans.select(
        F.lit("LOAN").alias("accrual_type"), "loan_id", F.lit(None).cast("bigint").alias("account_id"),
        F.col("outstanding").alias("basis_amount"), rate,
        F.when((status == "NPL") | unusable, F.lit(0)).otherwise(daily_interest(F.col("outstanding"), rate)).alias("accrued_amt"),
        F.when((status != "NPL") & unusable, "no usable rate").alias("warning"),
    )
    paid = F.lit(savings_rate).cast(loans.schema["rate_pct"].dataType)
    savings = accounts.filter((F.col("account_type") == "SAVINGS") & (status == "ACTIVE") & (_zero("balance") > 0))
    savings_rows = savings.select(
        F.lit("SAVINGS").alias("accrual_type"), F.lit(None).cast("bigint").alias("loan_id"), "account_id",
        F.col("balance").alias("basis_amount"), paid.alias("rate_pct"),
        daily_interest(F.col("balance"), paid).alias("accrued_amt"), F.lit(None).cast("string").alias("warning"),
    )
    return loan_rows.unionByName(savings_rows).withColumn("business_date", F.lit(date))


def accrual_ledger(accruals: DataFrame) -> DataFrame:
    """The two ledger legs of every accrual that is not zero."""
    loan = F.col("accrual_type") == "LOAN"
    debit = F.when(loan, RECEIVABLE).otherwise(INTEREST_EXPENSE)
    credit = F.when(loan, LOAN_INCOME).otherwise(DEPOSITS)
    return ledger_legs(accruals, debit, credit, F.col("accrued_amt"))


def fees(
    accounts: DataFrame, *, date: dt.date, overdraft_fee: float, maintenance_fee: float, maintenance_floor: float
) -> DataFrame:
    """Overdraft fees every day; maintenance fees at month end, waived from a balance on."""
    active, balance = F.col("status") == "ACTIVE", _zero("balance")
    overdrawn = accounts.filter(active & (balance < 0)).select(
        "account_id", F.lit("OVERDRAFT").alias("fee_code"), F.lit(overdraft_fee).alias("amount"), F.lit("N").alias("waived_yn")
    )
    month_end = F.lit(date) == F.last_day(F.lit(date))
    kept = accounts.filter(active & (F.col("account_type") == "CHECKING") & month_end).select(
        "account_id", F.lit("MAINTENANCE").alias("fee_code"), F.lit(maintenance_fee).alias("amount"),
        F.when(balance >= maintenance_floor, "Y").otherwise("N").alias("waived_yn"),
    )
    return overdrawn.unionByName(kept)


def monthly_interest(loans: DataFrame) -> DataFrame:
    """New outstanding amounts of active loans; loans without principal or rate fail and are marked."""
    interest = F.round(F.col("principal") * F.col("rate_pct") / F.lit(1200), 2)
    return loans.filter("status = 'ACTIVE'").select(
        "loan_id", interest.alias("interest"),
        F.when(interest.isNotNull(), F.coalesce("outstanding", "principal") + interest).alias("outstanding"),
        interest.isNull().alias("failed"),
    )


# ------------------------------------------------------------------ screening


def _posted_on(transactions: DataFrame, date: dt.date) -> DataFrame:
    return transactions.filter((F.col("status") == "POSTED") & on_day("created_at", date))


def high_value(transactions: DataFrame, *, date: dt.date, threshold: float) -> DataFrame:
    return _posted_on(transactions, date).filter(F.col("amount") >= threshold).select("txn_id", "account_id", "amount")


def structuring(transactions: DataFrame, *, date: dt.date, threshold: float, at_least: int = 3) -> DataFrame:
    """Accounts with several credits of a day, each below the threshold and together at least it."""
    small = _posted_on(transactions, date).filter((F.col("amount") < threshold) & F.col("txn_type").isin(*CREDITS))
    grouped = small.groupBy("account_id").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("total"))
    return grouped.filter((F.col("n") >= at_least) & (F.col("total") >= threshold))


def reactivated(transactions: DataFrame, *, date: dt.date, dormant_days: int) -> DataFrame:
    """Accounts that moved today after a long silence. One aggregation; no per-account window."""
    day = F.to_date("created_at")
    today = (F.col("status") == "POSTED") & (day == F.lit(date))
    facts = transactions.filter(F.col("created_at") < F.date_add(F.lit(date), 1)).groupBy("account_id").agg(
        F.max(F.when(today, F.col("txn_id"))).alias("txn_id"), F.sum(F.when(today, F.col("amount"))).alias("total"),
        F.max(F.when(day < F.lit(date), day)).alias("last_seen"),
    )
    silent = F.datediff(F.lit(date), "last_seen")
    return facts.filter(F.col("txn_id").isNotNull() & (silent >= dormant_days)).withColumn("silent_days", silent)


def pass_through(transactions: DataFrame, *, date: dt.date, threshold: float, share: float = 0.8) -> DataFrame:
    """Accounts whose credits of a day leave again almost whole on the same day."""
    kind, amount = F.col("txn_type"), F.col("amount")
    flows = _posted_on(transactions, date).groupBy("account_id").agg(
        F.sum(F.when(kind.isin(*CREDITS), amount).otherwise(0)).alias("credits"),
        F.sum(F.when(kind.isin(*DEBITS), amount).otherwise(0)).alias("debits"),
    )
    wanted = (F.col("credits") > 0) & (F.col("credits") >= threshold)
    return flows.filter(wanted & (F.col("debits") >= F.col("credits") * F.lit(str(share)).cast("decimal(4,2)")))


# ------------------------------------------------------------------ loans

# Fixed values: (days past due up to, bucket, stage, provision rate).
BUCKETS = (
    (0, "CURRENT", 1, "0.01"), (30, "DPD1_30", 2, "0.05"), (60, "DPD31_60", 2, "0.15"),
    (90, "DPD61_90", 2, "0.30"), (None, "DPD90_PLUS", 3, "0.60"),
)


def loan_schedule(loans: DataFrame, *, months: int, cutoff: Column) -> DataFrame:
    """Monthly instalments of each loan from ``opened_at``; those due by the cutoff are paid."""
    rows = loans.select("loan_id", "principal", "rate_pct", "opened_at", F.explode(F.sequence(F.lit(1), F.lit(months))).alias("installment_no"))
    due = F.add_months("opened_at", F.col("installment_no"))
    principal = F.round(F.col("principal") / months, 2)
    interest = F.round(F.col("principal") * F.coalesce("rate_pct", F.lit(0)) / F.lit(1200), 2)
    planned = rows.select(
        "loan_id", "installment_no", due.alias("due_date"), principal.alias("principal_due"), interest.alias("interest_due")
    )
    paid = F.col("due_date") <= cutoff
    return planned.withColumns({
        "paid_amt": F.when(paid, F.col("principal_due") + F.col("interest_due")).otherwise(F.lit(0)),
        "status": F.when(paid, "PAID").otherwise("DUE"),
    })


def _by_days(days: Column, column: int) -> Column:
    chain = None
    for bound, *values in BUCKETS[:-1]:
        step = (days <= bound, values[column])
        chain = F.when(*step) if chain is None else chain.when(*step)
    return chain.otherwise(BUCKETS[-1][column + 1])


def delinquency(loans: DataFrame, schedule: DataFrame, *, date: dt.date) -> DataFrame:
    """Days past due of the oldest unpaid instalment, its bucket, stage, provision and new status."""
    overdue = F.col("status").isin("DUE", "OVERDUE") & ((F.col("status") == "OVERDUE") | (F.col("due_date") < F.lit(date)))
    oldest = schedule.filter(overdue).groupBy("loan_id").agg(F.min("due_date").alias("oldest"))
    days = F.greatest(F.coalesce(F.datediff(F.lit(date), "oldest"), F.lit(0)), F.lit(0))
    graded = loans.filter("status <> 'CLOSED'").join(oldest, "loan_id", "left").withColumn("days_past_due", days)
    graded = graded.withColumns({
        "bucket": _by_days(F.col("days_past_due"), 0), "stage": _by_days(F.col("days_past_due"), 1),
        "rate": _by_days(F.col("days_past_due"), 2).cast("decimal(4,2)"),
    })
    status = F.when(F.col("stage") == 3, "NPL").when(F.col("stage") == 2, "DELINQUENT").otherwise("ACTIVE")
    return graded.select(
        "loan_id", "days_past_due", "bucket", "stage", "outstanding",
        F.round(_zero("outstanding") * F.col("rate"), 2).alias("provision_amt"),
        status.alias("new_status"), (status != F.col("status")).alias("changed"),
    )


# ------------------------------------------------------------------ settlement and ledger


def span_of(df: DataFrame, order: str, span: int) -> Column:
    """The number of the span of ``order`` a row is in; the width comes from the range and the number of rows."""
    facts = df.agg(F.struct(
        F.min(order).cast("double").alias("low"), F.max(order).cast("double").alias("high"), F.count(order).alias("n")
    ).alias("facts")).scalar()
    width = (facts["high"] - facts["low"] + 1) / F.greatest(F.ceil(facts["n"] / span), F.lit(1))
    return F.floor((F.col(order).cast("double") - facts["low"]) / F.greatest(width, F.lit(1.0)))


def running_total(df: DataFrame, group: str, order: str, amount: str, *, span: int = 1_000_000) -> DataFrame:
    """``df`` with ``running``, the sum of ``amount`` per group up to each row in ``order``.

    ``order`` is a unique whole number. Its range is cut into as many spans as ``span`` goes into the
    rows, so a span holds about that many rows whether numbers follow each other or are far apart.
    Totals per (group, span) are summed first; each span then starts from the total before it, so one
    group with a third of all rows is spread over as many tasks as it has spans.
    """
    spans = df.withColumn("__span", span_of(df, order, span))
    totals = spans.groupBy(group, "__span").agg(F.sum(amount).alias("__total"))
    before = W.partitionBy(group).orderBy("__span").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(group, "__span", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__start"))
    inside = W.partitionBy(group, "__span").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    # A row without a group stays, without a running sum.
    joined = spans.join(starts, [group, "__span"], "left")
    return joined.withColumn("running", F.col("__start") + F.sum(amount).over(inside)).drop("__span", "__start")


def settle(pending: DataFrame, accounts: DataFrame, *, span: int = 1_000_000) -> DataFrame:
    """Pending transactions in id order: posted with the balance they leave, or rejected and why."""
    known = accounts.select("account_id", "balance", F.col("status").alias("account_status"))
    joined = pending.join(known, "account_id", "left")
    signed = F.when(F.col("txn_type") == "CLEARING_DR", -F.col("amount")).otherwise(F.col("amount"))
    active = F.coalesce(F.col("account_status") == "ACTIVE", F.lit(False))
    moved = joined.withColumn("signed", F.when(active, signed).otherwise(F.lit(0)))
    total = running_total(moved, "account_id", "txn_id", "signed", span=span)
    reason = F.when(F.col("account_status").isNull(), "no account").when(
        ~active, F.concat(F.lit("account "), "account_status")
    )
    return total.select(
        "txn_id", "account_id", F.when(active, "POSTED").otherwise("REJECTED").alias("status"),
        F.when(active, F.col("signed")).alias("signed"),
        F.when(active, F.col("balance") + F.col("running")).alias("balance_after"), reason.alias("reason"),
    )


def ledger_legs(rows: DataFrame, debit: Column, credit: Column, amount: Column) -> DataFrame:
    """Both legs of a booking per row, amounts without sign to two places; zero books nothing."""
    size = F.round(F.abs(amount), 2)
    legs = F.array(
        F.struct(debit.alias("gl_code"), F.lit("DR").alias("dr_cr"), size.alias("amount")),
        F.struct(credit.alias("gl_code"), F.lit("CR").alias("dr_cr"), size.alias("amount")),
    )
    booked = rows.filter(F.coalesce(amount, F.lit(0)) != 0)
    kept = [c for c in rows.columns if c not in ("gl_code", "dr_cr", "amount")]
    return booked.select(*kept, F.inline(legs))


def settlement_ledger(settled: DataFrame) -> DataFrame:
    """Cash against deposits for every posted transaction, mirrored for money out."""
    incoming = F.col("signed") > 0
    debit = F.when(incoming, CASH).otherwise(DEPOSITS)
    credit = F.when(incoming, DEPOSITS).otherwise(CASH)
    return ledger_legs(settled.filter("status = 'POSTED'"), debit, credit, F.col("signed")).select(
        "txn_id", "account_id", "gl_code", "dr_cr", "amount"
    )


def suspense_ledger(unmatched: DataFrame) -> DataFrame:
    """Unmatched clearing items parked in suspense, both legs."""
    credit_item = F.col("direction") == "CR"
    debit = F.when(credit_item, CASH).otherwise(SUSPENSE)
    credit = F.when(credit_item, SUSPENSE).otherwise(CASH)
    return ledger_legs(unmatched, debit, credit, F.col("amount")).select("clearing_id", "gl_code", "dr_cr", "amount")


def closing_balances(settled: DataFrame) -> DataFrame:
    """The balance each touched account is left with."""
    return settled.filter("status = 'POSTED'").groupBy("account_id").agg(
        F.max_by("balance_after", "txn_id").alias("balance")
    )


def reconcile(ledger: DataFrame, accounts: DataFrame, posted: DataFrame) -> DataFrame:
    """Breaks: an unbalanced ledger, balances that disagree with the last posting, open suspense.

    ``ledger``: gl_code, dr_cr, amount; ``posted``: today's account_id, txn_id, balance_after.
    """
    debit = F.when(F.col("dr_cr") == "DR", F.col("amount"))
    credit = F.when(F.col("dr_cr") == "CR", F.col("amount"))
    in_suspense = F.col("gl_code") == SUSPENSE
    sums = ledger.agg(
        F.coalesce(F.sum(debit), F.lit(0)).alias("dr"), F.coalesce(F.sum(credit), F.lit(0)).alias("cr"),
        F.coalesce(F.sum(F.when(in_suspense, F.coalesce(debit, -credit))), F.lit(0)).alias("suspense"),
    )
    checks = F.array(
        F.struct(
            F.lit("GL_BALANCED").alias("check_code"), F.lit("CRITICAL").alias("severity"), F.lit(None).cast("bigint").alias("account_id"),
            F.col("dr").alias("expected"), F.col("cr").alias("actual"),
        ),
        F.struct(
            F.lit("SUSPENSE_OPEN").alias("check_code"), F.lit("WARNING").alias("severity"), F.lit(None).cast("bigint").alias("account_id"),
            F.lit(0).cast(sums.schema["suspense"].dataType).alias("expected"), F.col("suspense").alias("actual"),
        ),
    )
    totals = sums.select(F.inline(checks))
    last = posted.filter(F.col("balance_after").isNotNull()).groupBy("account_id").agg(
        F.max_by("balance_after", "txn_id").alias("expected")
    )
    balances = accounts.filter("status = 'ACTIVE'").join(last, "account_id").select(
        F.lit("STMT_VS_BALANCE").alias("check_code"), F.lit("CRITICAL").alias("severity"), F.col("account_id").cast("bigint").alias("account_id"),
        "expected", F.col("balance").alias("actual"),
    )
    breaks = totals.unionByName(balances).filter(F.round("expected", 2) != F.round("actual", 2))
    return breaks.withColumn("diff", F.round(F.col("actual") - F.col("expected"), 2))


def daily_snapshot(metrics: Mapping[str, tuple[DataFrame, Column]]) -> DataFrame:
    """(metric_code, metric_value): one aggregate per metric, stacked; nothing counts as 0."""
    result = None
    for code, (rows, aggregate) in metrics.items():
        value = F.round(F.coalesce(aggregate, F.lit(0)), 2).cast("decimal(24,2)")
        one = rows.agg(value.alias("metric_value")).select(F.lit(code).alias("metric_code"), "metric_value")
        result = one if result is None else result.unionByName(one)
    return result


def reset_cards(cards: DataFrame, *, date: dt.date) -> DataFrame:
    """Spending counters of earlier days start at zero; cards past their date expire."""
    stale = F.coalesce(F.col("daily_spent_date") < F.lit(date), F.lit(True))
    expired = (F.col("status") == "ACTIVE") & (F.col("expires_on") < F.lit(date))
    return cards.withColumns({
        "daily_spent": F.when(stale, F.lit(0)).otherwise(F.col("daily_spent")),
        "daily_spent_date": F.when(stale, F.lit(date)).otherwise(F.col("daily_spent_date")),
        "status": F.when(expired, "EXPIRED").otherwise(F.col("status")),
    })
