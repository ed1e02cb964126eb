"""Nightly batch queries: customers as accounts, events and orders as transactions, suppliers as loans.

Amounts are decimals in Spark and in SQL, and doubles only in the result.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablesense.operators import batch
from tablesense.session import cut_lineage
from tablesense.suite.estate import table
from tablesense.suite.registry import query

DAY = dt.date(2024, 1, 15)
MONTH_END = dt.date(2024, 1, 31)
_DATE, _NEXT = "DATE '2024-01-15'", "DATE '2024-01-16'"


def _money(col: str) -> Column:
    return F.col(col).cast("decimal(18,2)")


def _double(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def _accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("account_id"),
        F.when(F.col("c_mktsegment") == "HOUSEHOLD", "SAVINGS").otherwise("CHECKING").alias("account_type"),
        F.when(F.col("c_nationkey") % 5 == 0, "CLOSED").otherwise("ACTIVE").alias("status"),
        _money("c_acctbal").alias("balance"),
    )


_ACCOUNTS = (
    "a AS (SELECT c_custkey AS account_id, CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'SAVINGS' ELSE 'CHECKING' END AS account_type, "
    "CASE WHEN c_nationkey % 5 = 0 THEN 'CLOSED' ELSE 'ACTIVE' END AS status, c_acctbal::DECIMAL(18,2) AS balance FROM customer)"
)


def _transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.create_map(*[F.lit(x) for x in (
        "purchase", "CARD", "view", "DEPOSIT", "click", "CLEARING_CR", "signup", "CLEARING_DR", "error", "FEE"
    )])
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("txn_id"), F.col("user_id").alias("account_id"), kind[F.col("event_type")].alias("txn_type"),
        _money("value").alias("amount"), F.lit("POSTED").alias("status"), F.col("ts").alias("created_at"),
    )


_TRANSACTIONS = (
    "t AS (SELECT event_id AS txn_id, user_id AS account_id, CASE event_type WHEN 'purchase' THEN 'CARD' WHEN 'view' THEN 'DEPOSIT' "
    "WHEN 'click' THEN 'CLEARING_CR' WHEN 'signup' THEN 'CLEARING_DR' ELSE 'FEE' END AS txn_type, value::DECIMAL(18,2) AS amount, "
    "ts AS created_at FROM events)"
)
_TODAY = f"created_at >= {_DATE} AND created_at < {_NEXT}"


def _loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("s_nationkey")
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("loan_id"), F.abs(_money("s_acctbal")).alias("principal"), F.abs(_money("s_acctbal")).alias("outstanding"),
        F.when(n % 7 == 0, F.lit(None)).otherwise((n + 1) / F.lit(4)).cast("decimal(6,2)").alias("rate_pct"),
        F.when(n % 6 == 0, "CLOSED").when(n % 5 == 0, "NPL").otherwise("ACTIVE").alias("status"),
        F.add_months(F.lit(DAY), -(n % 12 + 1)).alias("opened_at"),
    )


_LOANS = (
    "l AS (SELECT s_suppkey AS loan_id, abs(s_acctbal::DECIMAL(18,2)) AS principal, abs(s_acctbal::DECIMAL(18,2)) AS outstanding, "
    "CASE WHEN s_nationkey % 7 = 0 THEN NULL ELSE ((s_nationkey + 1) / 4.0)::DECIMAL(6,2) END AS rate_pct, "
    "CASE WHEN s_nationkey % 6 = 0 THEN 'CLOSED' WHEN s_nationkey % 5 = 0 THEN 'NPL' ELSE 'ACTIVE' END AS status, "
    f"({_DATE} - to_months((s_nationkey % 12 + 1)::INTEGER))::DATE AS opened_at FROM supplier)"
)


def _exact(scaled: str, divisor: int, places: int) -> str:
    """round(scaled / 10000 / divisor, places) with whole-number arithmetic, for amounts from zero on."""
    half = f"(2 * ({scaled})::HUGEINT * {10 ** places} + {divisor * 10000})"
    return f"(({half} // {2 * divisor * 10000})::DOUBLE / {10 ** places})"


_ACCRUALS = (
    f"WITH {_ACCOUNTS}, {_LOANS} SELECT 'LOAN' AS accrual_type, loan_id AS ref_id, CASE WHEN status = 'NPL' OR rate_pct IS NULL OR rate_pct <= 0 THEN 0.0 "
    f"ELSE {_exact('(outstanding * 100)::BIGINT::HUGEINT * (rate_pct * 100)::BIGINT', 36500, 4)} END AS accrued_amt, "
    "coalesce(CASE WHEN status <> 'NPL' AND (rate_pct IS NULL OR rate_pct <= 0) THEN 'no usable rate' END, '') AS warning "
    "FROM l WHERE status <> 'CLOSED' AND outstanding > 0 UNION ALL "
    f"SELECT 'SAVINGS', account_id, {_exact('(balance * 100)::BIGINT::HUGEINT * 175', 36500, 4)}, '' FROM a "
    "WHERE account_type = 'SAVINGS' AND status = 'ACTIVE' AND balance > 0"
)


def _accruals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.accrue_interest(_loans(spark, sf_dir), _accounts(spark, sf_dir), savings_rate=1.75, date=DAY)


@query("B1", _ACCRUALS)
def interest_accrual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One day of interest on loans and savings, exact to four places."""
    rows = _accruals(spark, sf_dir)
    return _double(rows.select(
        "accrual_type", F.coalesce("loan_id", "account_id").alias("ref_id"), "accrued_amt", F.coalesce("warning", F.lit("")).alias("warning")
    ), "accrued_amt")


@query(
    "B1 J10",
    "SELECT CAST(day AS VARCHAR) AS day, CASE WHEN day = DATE '2024-01-15' THEN 0 ELSE (SELECT count(*) FROM customer WHERE "
    "c_mktsegment = 'HOUSEHOLD') END AS accrual_rows FROM (VALUES (DATE '2024-01-15'), (DATE '2024-01-16')) v(day)",
)
def accrual_runs_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day that has accruals already gets none; here the first day of two has them."""
    accounts = _accounts(spark, sf_dir)
    done = accounts.filter("account_type = 'SAVINGS'").select(F.lit(DAY).alias("business_date"))
    rows = accounts.filter("account_type = 'SAVINGS'")
    parts = [
        batch.unless_done(rows, done, day).agg(F.count(F.lit(1)).alias("accrual_rows"))
        .select(F.lit(str(day)).alias("day"), "accrual_rows")
        for day in (DAY, DAY + dt.timedelta(days=1))
    ]
    return parts[0].unionByName(parts[1])


@query(
    "B1",
    f"WITH x AS ({_ACCRUALS}), b AS (SELECT accrual_type, round(accrued_amt::DECIMAL(18,4), 2) AS amount FROM x WHERE accrued_amt <> 0) "
    "SELECT gl_code, dr_cr, sum(amount)::DOUBLE AS amount, count(*) AS legs FROM (SELECT CASE accrual_type WHEN 'LOAN' THEN '1210' ELSE '5010' END AS gl_code, "
    "'DR' AS dr_cr, amount FROM b UNION ALL SELECT CASE accrual_type WHEN 'LOAN' THEN '4010' ELSE '2010' END, 'CR', amount FROM b) GROUP BY 1, 2",
)
def interest_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    legs = batch.accrual_ledger(_accruals(spark, sf_dir))
    return _double(legs.groupBy("gl_code", "dr_cr").agg(F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("legs")), "amount")


@query(
    "B2",
    f"WITH {_ACCOUNTS} SELECT account_id, 'OVERDRAFT' AS fee_code, 15.0::DOUBLE AS amount, 'N' AS waived_yn FROM a WHERE status = 'ACTIVE' AND balance < 0 "
    "UNION ALL SELECT account_id, 'MAINTENANCE', 4.5, CASE WHEN balance >= 2500 THEN 'Y' ELSE 'N' END FROM a WHERE status = 'ACTIVE' AND account_type = 'CHECKING'",
)
def month_end_fees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.fees(_accounts(spark, sf_dir), date=MONTH_END, overdraft_fee=15.0, maintenance_fee=4.5, maintenance_floor=2500.0)


@query(
    "B2",
    f"WITH {_ACCOUNTS} SELECT account_id, 'OVERDRAFT' AS fee_code, 15.0::DOUBLE AS amount, 'N' AS waived_yn FROM a WHERE status = 'ACTIVE' AND balance < 0",
)
def mid_month_fees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.fees(_accounts(spark, sf_dir), date=DAY, overdraft_fee=15.0, maintenance_fee=4.5, maintenance_floor=2500.0)


@query(
    "B3",
    f"WITH {_TRANSACTIONS} SELECT account_id, count(*) AS n, sum(amount)::DOUBLE AS total FROM t WHERE {_TODAY} AND amount < 20 "
    "AND txn_type IN ('DEPOSIT', 'CLEARING_CR') GROUP BY 1 HAVING count(*) >= 2 AND sum(amount) >= 20",
)
def structuring_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _double(batch.structuring(_transactions(spark, sf_dir), date=DAY, threshold=20, at_least=2), "total")


@query("B4", f"WITH {_TRANSACTIONS} SELECT txn_id, account_id, amount::DOUBLE AS amount FROM t WHERE {_TODAY} AND amount >= 25")
def high_value_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _double(batch.high_value(_transactions(spark, sf_dir), date=DAY, threshold=25), "amount")


@query(
    "B5",
    f"WITH {_TRANSACTIONS}, n AS (SELECT account_id, max(txn_id) AS txn_id, sum(amount)::DOUBLE AS total FROM t WHERE {_TODAY} GROUP BY 1), "
    f"p AS (SELECT account_id, max(created_at)::DATE AS last_seen FROM t WHERE created_at < {_DATE} GROUP BY 1) "
    f"SELECT account_id, txn_id, total, CAST(last_seen AS VARCHAR) AS last_seen, CAST({_DATE} - last_seen AS INTEGER) AS silent_days "
    f"FROM n JOIN p USING (account_id) WHERE {_DATE} - last_seen >= 2",
)
def reactivation_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = batch.reactivated(_transactions(spark, sf_dir), date=DAY, dormant_days=2)
    return _double(found.withColumn("last_seen", F.col("last_seen").cast("string")), "total")


@query(
    "B6",
    f"WITH {_TRANSACTIONS}, f AS (SELECT account_id, sum(CASE WHEN txn_type IN ('DEPOSIT', 'CLEARING_CR') THEN amount ELSE 0 END) AS credits, "
    f"sum(CASE WHEN txn_type IN ('CARD', 'CLEARING_DR') THEN amount ELSE 0 END) AS debits FROM t WHERE {_TODAY} GROUP BY 1) "
    "SELECT account_id, credits::DOUBLE AS credits, debits::DOUBLE AS debits FROM f WHERE credits > 0 AND debits * 10 >= credits * 8 AND credits >= 10",
)
def pass_through_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _double(batch.pass_through(_transactions(spark, sf_dir), date=DAY, threshold=10), "credits", "debits")


# Two months before the business date everything due is paid.
_SCHEDULE = (
    "s AS (SELECT loan_id, i AS installment_no, (opened_at + to_months(i::INTEGER))::DATE AS due_date, "
    f"{_exact('(principal * 10000)::BIGINT', 24, 2)} AS principal_due, "
    f"{_exact('(principal * 100)::BIGINT::HUGEINT * (coalesce(rate_pct, 0) * 100)::BIGINT', 1200, 2)} AS interest_due, "
    "(opened_at + to_months(i::INTEGER))::DATE <= DATE '2023-11-15' AS paid FROM l, generate_series(1, 24) g(i))"
)


def _schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.loan_schedule(_loans(spark, sf_dir), months=24, cutoff=F.add_months(F.lit(DAY), -2))


@query(
    "B11",
    f"WITH {_LOANS}, {_SCHEDULE} SELECT loan_id, installment_no::INTEGER AS installment_no, CAST(due_date AS VARCHAR) AS due_date, principal_due, interest_due, "
    "round(CASE WHEN paid THEN principal_due + interest_due ELSE 0 END, 2) AS paid_amt, CASE WHEN paid THEN 'PAID' ELSE 'DUE' END AS status FROM s",
)
def amortisation_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _schedule(spark, sf_dir).withColumn("due_date", F.col("due_date").cast("string"))
    return _double(rows, "principal_due", "interest_due", "paid_amt")


@query(
    "B7",
    f"WITH {_LOANS}, {_SCHEDULE}, o AS (SELECT loan_id, min(due_date) AS oldest FROM s WHERE NOT paid AND due_date < {_DATE} GROUP BY 1), "
    f"d AS (SELECT l.*, greatest(coalesce({_DATE} - oldest, 0), 0)::INTEGER AS days_past_due FROM l LEFT JOIN o USING (loan_id) WHERE status <> 'CLOSED'), "
    "g AS (SELECT *, CASE WHEN days_past_due = 0 THEN 1 WHEN days_past_due <= 90 THEN 2 ELSE 3 END AS stage, CASE WHEN days_past_due = 0 THEN 1 "
    "WHEN days_past_due <= 30 THEN 5 WHEN days_past_due <= 60 THEN 15 WHEN days_past_due <= 90 THEN 30 ELSE 60 END AS pct FROM d) "
    "SELECT loan_id, days_past_due, CASE pct WHEN 1 THEN 'CURRENT' WHEN 5 THEN 'DPD1_30' WHEN 15 THEN 'DPD31_60' WHEN 30 THEN 'DPD61_90' ELSE 'DPD90_PLUS' END AS bucket, "
    f"stage, {_exact('(outstanding * 10000)::BIGINT::HUGEINT * pct', 100, 2)} AS provision_amt, "
    "CASE stage WHEN 3 THEN 'NPL' WHEN 2 THEN 'DELINQUENT' ELSE 'ACTIVE' END AS new_status, "
    "status <> CASE stage WHEN 3 THEN 'NPL' WHEN 2 THEN 'DELINQUENT' ELSE 'ACTIVE' END AS changed FROM g",
)
def delinquency_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = batch.delinquency(_loans(spark, sf_dir), _schedule(spark, sf_dir), date=DAY)
    return _double(graded.drop("outstanding"), "provision_amt")


def _pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as clearing items; one in fifty names an account that does not exist."""
    account = F.when(F.col("o_orderkey") % 50 == 0, F.lit(-1)).otherwise(F.col("o_custkey"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("txn_id"), account.cast("bigint").alias("account_id"),
        F.when(F.col("o_orderstatus") == "F", "CLEARING_DR").otherwise("CLEARING_CR").alias("txn_type"),
        _money("o_totalprice").alias("amount"),
    )


_PENDING = (
    "p AS (SELECT o_orderkey AS txn_id, CASE WHEN o_orderkey % 50 = 0 THEN -1 ELSE o_custkey END AS account_id, "
    "CASE WHEN o_orderstatus = 'F' THEN -o_totalprice::DECIMAL(18,2) ELSE o_totalprice::DECIMAL(18,2) END AS signed FROM orders)"
)
_SETTLED = (
    f"WITH {_ACCOUNTS}, {_PENDING}, j AS (SELECT p.*, a.status, a.balance FROM p LEFT JOIN a USING (account_id)), "
    "s AS (SELECT txn_id, account_id, CASE WHEN status = 'ACTIVE' THEN 'POSTED' ELSE 'REJECTED' END AS status, "
    "CASE WHEN status = 'ACTIVE' THEN signed END AS signed, CASE WHEN status = 'ACTIVE' THEN balance + sum(CASE WHEN status = 'ACTIVE' THEN signed ELSE 0 END) "
    "OVER (PARTITION BY account_id ORDER BY txn_id) END AS balance_after, CASE WHEN status IS NULL THEN 'no account' WHEN status <> 'ACTIVE' "
    "THEN 'account ' || status ELSE '' END AS reason FROM j) "
)


def _settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.settle(_pending(spark, sf_dir), _accounts(spark, sf_dir), span=1000)


@query(
    "B10",
    _SETTLED + "SELECT txn_id, account_id, status, signed::DOUBLE AS signed, balance_after::DOUBLE AS balance_after, reason FROM s",
)
def settlement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running balances in id order, in spans, so that no account has to fit one task."""
    rows = _settled(spark, sf_dir).withColumn("reason", F.coalesce("reason", F.lit("")))
    return _double(rows, "signed", "balance_after")


_LEDGER = (
    "g AS (SELECT CASE WHEN signed > 0 THEN '1010' ELSE '2010' END AS gl_code, 'DR' AS dr_cr, abs(signed) AS amount FROM s WHERE status = 'POSTED' AND signed <> 0 "
    "UNION ALL SELECT CASE WHEN signed > 0 THEN '2010' ELSE '1010' END, 'CR', abs(signed) FROM s WHERE status = 'POSTED' AND signed <> 0)"
)


@query("B10", _SETTLED.rstrip() + f", {_LEDGER} SELECT gl_code, dr_cr, sum(amount)::DOUBLE AS amount, count(*) AS legs FROM g GROUP BY 1, 2")
def settlement_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    legs = batch.settlement_ledger(_settled(spark, sf_dir))
    return _double(legs.groupBy("gl_code", "dr_cr").agg(F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("legs")), "amount")


def _unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").filter("o_orderpriority = '5-LOW'").select(
        F.col("o_orderkey").alias("clearing_id"), F.when(F.col("o_orderstatus") == "F", "DR").otherwise("CR").alias("direction"),
        _money("o_totalprice").alias("amount"),
    )


_SUSPENSE = (
    "u AS (SELECT o_orderkey AS clearing_id, o_orderstatus <> 'F' AS cr, o_totalprice::DECIMAL(18,2) AS amount FROM orders WHERE o_orderpriority = '5-LOW'), "
    "ul AS (SELECT clearing_id, CASE WHEN cr THEN '1010' ELSE '9999' END AS gl_code, 'DR' AS dr_cr, amount FROM u UNION ALL "
    "SELECT clearing_id, CASE WHEN cr THEN '9999' ELSE '1010' END, 'CR', amount FROM u)"
)


@query("B10", f"WITH {_SUSPENSE} SELECT clearing_id, gl_code, dr_cr, amount::DOUBLE AS amount FROM ul")
def suspense_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _double(batch.suspense_ledger(_unmatched(spark, sf_dir)), "amount")


@query(
    "B8",
    _SETTLED.rstrip() + f", {_SUSPENSE}, last AS (SELECT account_id, arg_max(balance_after, txn_id) AS expected FROM s WHERE status = 'POSTED' GROUP BY 1), "
    "f AS (SELECT sum(CASE WHEN gl_code = '9999' THEN CASE dr_cr WHEN 'DR' THEN amount ELSE -amount END END) AS suspense FROM ul) "
    "SELECT 'STMT_VS_BALANCE' AS check_code, 'CRITICAL' AS severity, account_id, expected::DOUBLE AS expected, balance::DOUBLE AS actual, (balance - expected)::DOUBLE AS diff "
    "FROM a JOIN last USING (account_id) WHERE a.status = 'ACTIVE' AND balance <> expected UNION ALL "
    "SELECT 'SUSPENSE_OPEN', 'WARNING', NULL, 0.0, suspense::DOUBLE, suspense::DOUBLE FROM f WHERE suspense <> 0",
)
def reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts still at their old balance break against their last posting; suspense is open, the ledger balances."""
    # The settlement is the table that ledger, statement and balance checks all read.
    settled = cut_lineage(_settled(spark, sf_dir))
    ledger = batch.settlement_ledger(settled).select("gl_code", "dr_cr", "amount").unionByName(
        batch.suspense_ledger(_unmatched(spark, sf_dir)).select("gl_code", "dr_cr", "amount")
    )
    posted = settled.filter("status = 'POSTED'").select("account_id", "txn_id", "balance_after")
    return _double(batch.reconcile(ledger, _accounts(spark, sf_dir), posted), "expected", "actual", "diff")


@query(
    "B8 B10",
    _SETTLED + "SELECT account_id, arg_max(balance_after, txn_id)::DOUBLE AS balance FROM s WHERE status = 'POSTED' GROUP BY 1",
)
def closing_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _double(batch.closing_balances(_settled(spark, sf_dir)), "balance")


@query(
    "B9",
    f"WITH {_ACCOUNTS}, {_LOANS}, {_TRANSACTIONS}, {_SCHEDULE}, x AS ({_ACCRUALS.replace('WITH ' + _ACCOUNTS + ', ' + _LOANS, '')}) "
    "SELECT 'CUSTOMER_DEPOSITS_TOTAL' AS metric_code, sum(balance)::DOUBLE AS metric_value FROM a WHERE status = 'ACTIVE' UNION ALL "
    "SELECT 'LOAN_BOOK_GROSS', sum(outstanding)::DOUBLE FROM l WHERE status <> 'CLOSED' UNION ALL "
    "SELECT 'NPL_EXPOSURE', coalesce(sum(outstanding), 0)::DOUBLE FROM l WHERE status = 'NPL' UNION ALL "
    "SELECT 'INTEREST_ACCRUED_TODAY', round(sum(accrued_amt::DECIMAL(18,4)), 2)::DOUBLE FROM x WHERE accrual_type = 'LOAN' UNION ALL "
    "SELECT 'FEE_INCOME_TODAY', sum(15.0)::DOUBLE FROM a WHERE status = 'ACTIVE' AND balance < 0 UNION ALL "
    f"SELECT 'AML_ALERTS_OPEN', count(*)::DOUBLE FROM t WHERE {_TODAY} AND amount >= 25 UNION ALL "
    f"SELECT 'TXN_VOLUME_TODAY', count(*)::DOUBLE FROM t WHERE {_TODAY} UNION ALL "
    "SELECT 'CLEARING_UNMATCHED', count(*)::DOUBLE FROM orders WHERE o_orderpriority = '5-LOW' UNION ALL "
    f"SELECT 'IFRS9_PROVISION_STOCK', sum({_exact('(outstanding * 10000)::BIGINT::HUGEINT * pct', 100, 2)}::DECIMAL(18,2))::DOUBLE FROM (SELECT outstanding, CASE WHEN d <= 0 THEN 1 "
    "WHEN d <= 30 THEN 5 WHEN d <= 60 THEN 15 WHEN d <= 90 THEN 30 ELSE 60 END AS pct FROM (SELECT outstanding, coalesce("
    f"{_DATE} - (SELECT min(due_date) FROM s WHERE s.loan_id = l.loan_id AND NOT paid AND due_date < {_DATE}), 0) AS d FROM l WHERE status <> 'CLOSED'))",
)
def daily_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine figures of the day in long form."""
    accounts, loans = _accounts(spark, sf_dir), _loans(spark, sf_dir)
    transactions = _transactions(spark, sf_dir)
    arrears = batch.delinquency(loans, _schedule(spark, sf_dir), date=DAY)
    charged = batch.fees(accounts, date=DAY, overdraft_fee=15.0, maintenance_fee=4.5, maintenance_floor=2500.0).filter("waived_yn = 'N'")
    count = F.count(F.lit(1))
    metrics = {
        "CUSTOMER_DEPOSITS_TOTAL": (accounts.filter("status = 'ACTIVE'"), F.sum("balance")),
        "LOAN_BOOK_GROSS": (loans.filter("status <> 'CLOSED'"), F.sum("outstanding")),
        "NPL_EXPOSURE": (loans.filter("status = 'NPL'"), F.sum("outstanding")),
        "IFRS9_PROVISION_STOCK": (arrears, F.sum("provision_amt")),
        "INTEREST_ACCRUED_TODAY": (_accruals(spark, sf_dir).filter("accrual_type = 'LOAN'"), F.sum("accrued_amt")),
        "FEE_INCOME_TODAY": (charged, F.sum("amount")),
        "AML_ALERTS_OPEN": (batch.high_value(transactions, date=DAY, threshold=25), count),
        "CLEARING_UNMATCHED": (_unmatched(spark, sf_dir), count),
        "TXN_VOLUME_TODAY": (transactions.filter(batch.on_day("created_at", DAY)), count),
    }
    return _double(batch.daily_snapshot(metrics), "metric_value")


@query(
    "B12",
    "SELECT c_custkey AS card_id, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 100 ELSE 0 END::INTEGER AS daily_spent, '2024-01-15' AS daily_spent_date, "
    "CASE WHEN c_nationkey % 5 <> 0 AND c_custkey % 4 = 0 THEN 'EXPIRED' WHEN c_nationkey % 5 <> 0 THEN 'ACTIVE' ELSE 'BLOCKED' END AS status FROM customer",
)
def card_resets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as cards: two of three last spent on an earlier day or never, one of four is past its date."""
    key = F.col("c_custkey")
    spent_on = F.when(key % 3 == 0, F.lit(DAY)).when(key % 3 == 1, F.date_sub(F.lit(DAY), 1))
    cards = table(spark, sf_dir, "customer").select(
        key.alias("card_id"), (key % 100).cast("int").alias("daily_spent"), spent_on.alias("daily_spent_date"),
        F.when(F.col("c_nationkey") % 5 == 0, "BLOCKED").otherwise("ACTIVE").alias("status"),
        F.when(key % 4 == 0, F.date_sub(F.lit(DAY), 1)).otherwise(F.lit(DAY)).alias("expires_on"),
    )
    reset = batch.reset_cards(cards, date=DAY).drop("expires_on")
    return reset.withColumn("daily_spent_date", F.col("daily_spent_date").cast("string"))


@query(
    "B13",
    f"WITH {_LOANS}, i AS (SELECT *, CASE WHEN rate_pct IS NOT NULL THEN {_exact('(principal * 100)::BIGINT::HUGEINT * (rate_pct * 100)::BIGINT', 1200, 2)} END AS interest "
    "FROM l WHERE status = 'ACTIVE') SELECT loan_id, interest, round(outstanding::DOUBLE + interest, 2) AS outstanding, interest IS NULL AS failed FROM i",
)
def monthly_loan_interest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _double(batch.monthly_interest(_loans(spark, sf_dir)), "interest", "outstanding")
