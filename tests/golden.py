"""The 24-row table whose findings are counted by hand."""

LATE = {1: "bad@@", 5: "nope", 11: "x@@y", 3: None, 8: None}
STATES = ["Texas"] * 8 + ["texas"] * 2 + ["TEXAS"] + ["Ohio"] * 7 + ["ohio"] * 2 + ["Utah"] * 2
SCHEMA = "customer_id long, email string, state string, order_date string, quantity string, revenue double, notes string, region string, tier string, tier_copy string"


def golden_rows():
    rows = []
    for i in range(22):
        date = {5: "not a date", 11: "31/31/2024"}.get(i, f"2024-01-{i + 1:02d}")
        quantity = str(i + 1) if i < 5 else ("one", "two", "three", "four")[i % 4]
        revenue = {20: None, 21: -50.0}.get(i, 100.0 + 10 * i)
        notes = {0: "  alpha", 1: "beta  ", 2: "   "}.get(i, "gamma")
        tier = "ABC"[i % 3]
        rows.append((i + 1, LATE.get(i, f"a{i}@x.com"), STATES[i], date, quantity, revenue, notes, "APAC", tier, tier))
    return rows + [rows[20], rows[21]]
