"""Batch rules, and the spread running total against a plain loop."""

import datetime as dt
import random
from decimal import Decimal

from pyspark.sql import functions as F

from tablesense.operators import batch

DAY = dt.date(2026, 3, 31)
MONEY = "decimal(18,2)"


def d(x):
    return Decimal(str(x))


def test_running_total_with_a_hot_account(make):
    random.seed(7)
    ids = random.sample(range(5000), 900)
    rows = [(i, 1 if random.random() < 0.6 else random.randrange(2, 9), random.randrange(-50, 50)) for i in ids]
    got = {r["i"]: r["running"] for r in batch.running_total(make(rows, "i int, a int, v int"), "a", "i", "v", span=37).collect()}
    balance, want = {}, {}
    for i, a, v in sorted(rows):
        balance[a] = balance.get(a, 0) + v
        want[i] = balance[a]
    assert got == want


def test_settlement(make):
    accounts = make([(1, d(100), "ACTIVE"), (2, d(5), "CLOSED")], f"account_id bigint, balance {MONEY}, status string")
    pending = make(
        [(10, 1, "CLEARING_DR", d(30)), (15, None, "CLEARING_CR", d(2)), (11, 1, "CLEARING_CR", d(50)), (12, 2, "CLEARING_CR", d(1)), (13, 9, "CLEARING_CR", d(1)), (14, 1, "CLEARING_CR", d(0))],
        f"txn_id bigint, account_id bigint, txn_type string, amount {MONEY}",
    )
    settled = batch.settle(pending, accounts, span=2)
    rows = {r["txn_id"]: (r["status"], r["balance_after"], r["reason"]) for r in settled.collect()}
    assert rows == {
        10: ("POSTED", d("70.00"), None), 11: ("POSTED", d("120.00"), None), 12: ("REJECTED", None, "account CLOSED"),
        13: ("REJECTED", None, "no account"), 14: ("POSTED", d("120.00"), None),
        15: ("REJECTED", None, "no account"),
    }
    legs = {(r["txn_id"], r["gl_code"], r["dr_cr"], r["amount"]) for r in batch.settlement_ledger(settled).collect()}
    assert legs == {
        (10, "2010", "DR", d("30.00")), (10, "1010", "CR", d("30.00")), (11, "1010", "DR", d("50.00")), (11, "2010", "CR", d("50.00")),
    }
    closing = batch.closing_balances(settled)
    assert [(r["account_id"], r["balance"]) for r in closing.collect()] == [(1, d("120.00"))]
    posted = settled.filter("status = 'POSTED'").select("account_id", "txn_id", "balance_after")
    ledger = batch.settlement_ledger(settled).select("gl_code", "dr_cr", "amount")
    updated = closing.withColumn("status", F.lit("ACTIVE"))
    assert batch.reconcile(ledger, updated, posted).count() == 0
    breaks = batch.reconcile(ledger.filter("dr_cr = 'DR'"), accounts, posted).collect()
    assert {b["check_code"]: b["diff"] for b in breaks} == {"GL_BALANCED": d("-80.00"), "STMT_VS_BALANCE": d("-20.00")}


def test_unmatched_items_go_to_suspense(make):
    items = make([(1, "CR", d(10)), (2, "DR", d(4))], f"clearing_id int, direction string, amount {MONEY}")
    legs = {(r["clearing_id"], r["gl_code"], r["dr_cr"]) for r in batch.suspense_ledger(items).collect()}
    assert legs == {(1, "1010", "DR"), (1, "9999", "CR"), (2, "9999", "DR"), (2, "1010", "CR")}


def test_interest(make):
    loans = make(
        [(1, d(1000), d("3.65"), "ACTIVE"), (2, d(1000), d("3.65"), "NPL"), (3, d(1000), None, "ACTIVE"), (4, d(1000), d(9), "CLOSED"), (5, d(0), d(9), "ACTIVE")],
        f"loan_id bigint, outstanding {MONEY}, rate_pct decimal(6,2), status string",
    )
    accounts = make([(7, "SAVINGS", "ACTIVE", d(365)), (8, "SAVINGS", "ACTIVE", d(-1)), (9, "CHECKING", "ACTIVE", d(10))],
                    f"account_id bigint, account_type string, status string, balance {MONEY}")
    accrued = batch.accrue_interest(loans, accounts, savings_rate=2.0, date=DAY)
    rows = {(r["accrual_type"], r["loan_id"] or r["account_id"]): (float(r["accrued_amt"]), r["warning"]) for r in accrued.collect()}
    assert rows == {("LOAN", 1): (0.1, None), ("LOAN", 2): (0.0, None), ("LOAN", 3): (0.0, "no usable rate"), ("SAVINGS", 7): (0.02, None)}
    legs = batch.accrual_ledger(accrued).groupBy("dr_cr").agg(F.sum("amount").alias("s")).collect()
    assert {r["dr_cr"]: float(r["s"]) for r in legs} == {"DR": 0.12, "CR": 0.12}
    done = make([(DAY,)], "business_date date")
    assert batch.unless_done(accrued.drop("business_date"), done, DAY).count() == 0
    assert batch.unless_done(accrued.drop("business_date"), done, DAY + dt.timedelta(days=1)).count() == 4


def test_fees(make):
    accounts = make([(1, "CHECKING", "ACTIVE", d(-5)), (2, "CHECKING", "ACTIVE", d(9000)), (3, "SAVINGS", "CLOSED", d(-5))],
                    f"account_id int, account_type string, status string, balance {MONEY}")

    def charged(day):
        rows = batch.fees(accounts, date=day, overdraft_fee=15.0, maintenance_fee=4.5, maintenance_floor=2500.0).collect()
        return {(r["account_id"], r["fee_code"], r["waived_yn"]) for r in rows}

    assert charged(dt.date(2026, 3, 30)) == {(1, "OVERDRAFT", "N")}
    assert charged(DAY) == {(1, "OVERDRAFT", "N"), (1, "MAINTENANCE", "N"), (2, "MAINTENANCE", "Y")}


def transactions(make):
    noon = dt.datetime(2026, 3, 31, 12)
    rows = [(i, 1, "DEPOSIT", d(4000), "POSTED", noon) for i in range(3)]
    rows += [(10, 1, "CARD", d(11000), "POSTED", noon), (11, 2, "DEPOSIT", d(60000), "POSTED", noon), (12, 3, "DEPOSIT", d(70000), "PENDING", noon)]
    rows += [(5, 2, "DEPOSIT", d(1), "POSTED", noon - dt.timedelta(days=100)), (6, 1, "DEPOSIT", d(1), "POSTED", noon - dt.timedelta(days=1))]
    return make(rows, f"txn_id int, account_id int, txn_type string, amount {MONEY}, status string, created_at timestamp_ntz")


def test_screening(make):
    txns = transactions(make)
    assert [r["txn_id"] for r in batch.high_value(txns, date=DAY, threshold=50000).collect()] == [11]
    assert [(r["account_id"], r["n"]) for r in batch.structuring(txns, date=DAY, threshold=10000).collect()] == [(1, 3)]
    assert [(r["account_id"], r["silent_days"], r["txn_id"]) for r in batch.reactivated(txns, date=DAY, dormant_days=90).collect()] == [(2, 100, 11)]
    assert [r["account_id"] for r in batch.pass_through(txns, date=DAY, threshold=10000).collect()] == [1]


def test_schedule_and_delinquency(make):
    loans = make(
        [(1, d(1200), d(12), d(1000), "ACTIVE", dt.date(2025, 12, 15)), (2, d(100), d(12), d(100), "NPL", dt.date(2026, 3, 15)), (3, d(9), d(1), d(9), "CLOSED", DAY)],
        f"loan_id int, principal {MONEY}, rate_pct decimal(6,2), outstanding {MONEY}, status string, opened_at date",
    )
    plan = batch.loan_schedule(loans, months=12, cutoff=F.add_months(F.lit(DAY), -2))
    first = plan.filter("loan_id = 1 AND installment_no = 1").collect()[0]
    assert (first["due_date"], float(first["principal_due"]), float(first["interest_due"]), first["status"]) == (dt.date(2026, 1, 15), 100.0, 12.0, "PAID")
    rows = {r["loan_id"]: r for r in batch.delinquency(loans, plan, date=DAY).collect()}
    assert (rows[1]["days_past_due"], rows[1]["bucket"], float(rows[1]["provision_amt"]), rows[1]["new_status"]) == (44, "DPD31_60", 150.0, "DELINQUENT")
    assert (rows[2]["days_past_due"], rows[2]["bucket"], rows[2]["new_status"], rows[2]["changed"]) == (0, "CURRENT", "ACTIVE", True)
    assert 3 not in rows


def test_cards_and_monthly_interest(make):
    cards = make([(1, 9, dt.date(2026, 3, 30), "ACTIVE", DAY), (2, 9, DAY, "ACTIVE", dt.date(2026, 3, 1)), (3, 9, None, "BLOCKED", dt.date(2026, 3, 1))],
                 "card_id int, daily_spent int, daily_spent_date date, status string, expires_on date")
    rows = {r["card_id"]: (r["daily_spent"], r["daily_spent_date"], r["status"]) for r in batch.reset_cards(cards, date=DAY).collect()}
    assert rows == {1: (0, DAY, "ACTIVE"), 2: (9, DAY, "EXPIRED"), 3: (0, DAY, "BLOCKED")}
    loans = make([(1, d(1200), d(10), None, "ACTIVE"), (2, d(1200), None, d(5), "ACTIVE"), (3, d(1), d(1), d(1), "NPL")],
                 f"loan_id int, principal {MONEY}, rate_pct decimal(6,2), outstanding {MONEY}, status string")
    rows = {r["loan_id"]: (r["interest"], r["outstanding"], r["failed"]) for r in batch.monthly_interest(loans).collect()}
    assert rows[1][:2] == (d("10.00"), d("1210.00")) and rows[2] == (None, None, True) and 3 not in rows


def test_snapshot_counts_nothing_as_zero(make):
    empty = make([], f"v {MONEY}")
    row = batch.daily_snapshot({"X": (empty, F.sum("v"))}).collect()[0]
    assert (row["metric_code"], float(row["metric_value"])) == ("X", 0.0)


def test_sparse_numbers_of_one_account_spread_over_spans(make):
    rows = [(i * 5_000_000, 1, 1.0) for i in range(1000)]
    df = make(rows, "txn_id long, account_id long, amount double")
    sizes = df.select(batch.span_of(df, "txn_id", 50).alias("s")).groupBy("s").count().collect()
    assert len(sizes) == 20 and max(r["count"] for r in sizes) <= 51
    found = batch.running_total(df, "account_id", "txn_id", "amount", span=50).collect()
    assert all(r["running"] == r["txn_id"] // 5_000_000 + 1 for r in found)
