"""Ledgers, credits and journals as SQL over the given tables."""

from oracle import CTES, cte

HOLIDAYS = "(DATE '2024-01-01', DATE '2024-01-08', DATE '2024-01-22')"

cte("cal0", "SELECT CAST(d AS DATE) AS d FROM range(DATE '1994-12-01', DATE '2024-06-01', INTERVAL 1 DAY) t(d)")
for prefix, business in (("", f"(isodow(d) < 6 AND d NOT IN {HOLIDAYS})"), ("o", "(isodow(d) < 6)")):
    cte(f"{prefix}cal", f"SELECT d, {business} AS is_bd, CAST(SUM(CASE WHEN {business} THEN 1 ELSE 0 END) OVER (ORDER BY d) AS BIGINT) AS ord FROM cal0")
    cte(f"{prefix}bday", f"SELECT ord, d FROM {prefix}cal WHERE is_bd")
    # the business days after each day
    cte(
        f"{prefix}ahead",
        f"""SELECT c.d, c.ord, c.is_bd, n1.d AS n1, n2.d AS n2, n3.d AS n3 FROM {prefix}cal c
        LEFT JOIN {prefix}bday n1 ON n1.ord = c.ord + 1 LEFT JOIN {prefix}bday n2 ON n2.ord = c.ord + 2
        LEFT JOIN {prefix}bday n3 ON n3.ord = c.ord + 3""",
    )

cte(
    "mov",
    """
SELECT 'mov_' || substr(sha256('events|evt-' || event_id || '|' || CAST(CAST(ts - INTERVAL 5 HOUR AS DATE) AS VARCHAR) || '|'
         || CAST(CAST(round(value * 100) AS BIGINT) * 1000 AS VARCHAR) || '|CHARGE|evt=' || event_id), 1, 16) AS id,
       'gw:' || number AS account_id, 'bank:' || (number - number % 2) AS bank_account_id,
       CASE number % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'gamma' END AS channel,
       event_id, 'evt-' || event_id AS external_id, ts AS occurred_at, CAST(ts - INTERVAL 5 HOUR AS DATE) AS value_date,
       CAST(round(value * 100) AS BIGINT) * 1000 AS amount_cents, hour(ts - INTERVAL 5 HOUR) AS lh
FROM (SELECT *, user_id % 10 + 10 * (user_id // 75) AS number FROM events) WHERE event_type = 'purchase'""",
)
cte(
    "acc",
    """
SELECT *, CASE WHEN channel = 'alpha' AND lh >= 21 THEN value_date + 1 ELSE value_date END AS accrual_date,
       CASE channel WHEN 'alpha' THEN CASE WHEN lh >= 21 THEN value_date + 1 ELSE value_date END
                    WHEN 'beta' THEN value_date + CAST(7 - isodow(value_date) AS INTEGER)
                    ELSE CAST(last_day(value_date) AS DATE) END AS close_date FROM mov""",
)
cte("due", "SELECT a.*, h.n1 AS due_date FROM acc a JOIN ahead h ON h.d = a.close_date")
cte(
    "bat0",
    """
SELECT account_id, bank_account_id, channel, due_date, max(close_date) AS batch_date, CAST(sum(amount_cents) AS BIGINT) AS gross_cents, count(*) AS n_charges,
       row_number() OVER (PARTITION BY account_id ORDER BY due_date) AS o
FROM due GROUP BY account_id, bank_account_id, channel, due_date""",
)
cte(
    "bat",
    """
SELECT 'bat_' || substr(sha256(account_id || '|' || CAST(batch_date AS VARCHAR)), 1, 16) AS batch_id, *,
       CAST(0 AS BIGINT) AS fee_cents, CAST(0 AS BIGINT) AS deductions_cents, 0 AS deduction_kinds, gross_cents AS expected_net_cents,
       CASE channel WHEN 'gamma' THEN 0.02 ELSE 0.04 END::DOUBLE AS band_lo, CASE channel WHEN 'gamma' THEN 0.08 ELSE 0.05 END::DOUBLE AS band_hi
FROM bat0""",
)
cte(
    "b2",
    """
SELECT *, o % 8 AS kind, lead(gross_cents) OVER w AS next_gross, lead(due_date) OVER w AS next_due,
       gross_cents - (gross_cents * (430 + 2 * (o % 10))) // 10000 AS net
FROM bat WINDOW w AS (PARTITION BY account_id ORDER BY due_date)""",
)
cte(
    "cred0",
    """
SELECT account_id, bank_account_id, o, kind, due_date AS value_date, net AS cents, upper(channel) || ' PAY' AS counterparty, 'a' AS tag FROM b2 WHERE kind IN (0, 4)
UNION ALL SELECT account_id, bank_account_id, o, kind, due_date, (net * n * (n + 1)) // (m * (m + 1)) - (net * n * (n - 1)) // (m * (m + 1)), upper(channel) || ' PAY', substr('abcdef', n, 1)
  FROM (SELECT *, 2 + (o // 8) % 5 AS m FROM b2 WHERE kind = 1) s, (VALUES (1), (2), (3), (4), (5), (6)) p(n) WHERE n <= m
UNION ALL SELECT b.account_id, b.bank_account_id, b.o, b.kind, h.n1, b.net, upper(b.channel) || ' PAY', 'a' FROM b2 b JOIN ahead h ON h.d = b.due_date WHERE b.kind = 3
UNION ALL SELECT account_id, bank_account_id, o, kind, due_date, net, upper(channel) || ' PAY', 'b' FROM b2 WHERE kind = 4
UNION ALL SELECT account_id, bank_account_id, o, kind, due_date, net, 'OTHER PAYER', 'a' FROM b2 WHERE kind = 5
UNION ALL SELECT account_id, bank_account_id, o, kind, next_due, (gross_cents + next_gross) - ((gross_cents + next_gross) * 445) // 10000, upper(channel) || ' PAY', 'm'
  FROM b2 WHERE kind = 6 AND next_gross IS NOT NULL
UNION ALL SELECT 'gw:0', 'bank:0', event_id, 9, DATE '2024-01-10', event_id + 1000, 'GAMMA PAY', 'x' FROM events WHERE event_type = 'error'""",
)
CREDIT = """
SELECT 'mov_' || substr(sha256('bank||' || CAST(value_date AS VARCHAR) || '|' || CAST(cents AS VARCHAR) || '|TRANSFER_IN|' || account_id || ';' || o || ';' || kind || ';' || tag), 1, 16) AS deposit_id,
       account_id, bank_account_id, value_date, CAST(cents AS BIGINT) AS cents, counterparty, 'PAGO DE PROV ' || counterparty AS description,
       {owner} AS owner FROM {source}"""
cte("cred", CREDIT.format(source="cred0", owner="CASE WHEN contains(counterparty, 'ALPHA') THEN 'alpha' WHEN contains(counterparty, 'BETA') THEN 'beta' WHEN contains(counterparty, 'GAMMA') THEN 'gamma' END"))

# orders: a channel that states its deductions
cte(
    "ocents",
    """
SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS c, (CAST(round(o_totalprice * 100) AS BIGINT) * 3) // 100 AS fee FROM orders""",
)
cte(
    "omov0",
    """
SELECT o_orderkey, o_orderpriority, o_custkey, CAST(o_orderdate AS DATE) AS value_date, 'CHARGE' AS type, c AS cents FROM ocents
UNION ALL SELECT o_orderkey, o_orderpriority, o_custkey, CAST(o_orderdate AS DATE), 'FEE', -fee FROM ocents
UNION ALL SELECT o_orderkey, o_orderpriority, o_custkey, CAST(o_orderdate AS DATE), 'TAX', -((fee * 19) // 100) FROM ocents
UNION ALL SELECT o_orderkey, o_orderpriority, o_custkey, CAST(o_orderdate AS DATE), 'WITHHOLDING', -((c * 15) // 1000) FROM ocents
UNION ALL SELECT o_orderkey, o_orderpriority, o_custkey, CAST(o_orderdate AS DATE), 'REFUND', -(c // 10) FROM ocents WHERE o_orderstatus = 'P' AND o_orderkey % 5 = 0""",
)
cte(
    "omov",
    """
SELECT 'mov_' || substr(sha256('orders|ord-' || o_orderkey || '|' || CAST(value_date AS VARCHAR) || '|' || cents || '|' || type || '|ord=' || o_orderkey || ';' || type), 1, 16) AS id,
       'ord:' || number AS account_id, 'bank:ord:' || number AS bank_account_id, 'delta' AS channel,
       'ord-' || o_orderkey AS external_id, value_date, type, CAST(cents AS BIGINT) AS amount_cents
FROM (SELECT *, CAST(left(o_orderpriority, 1) AS BIGINT) + 10 * (o_custkey // 1500) AS number FROM omov0)""",
)
cte("odue", "SELECT m.*, m.value_date AS close_date, h.n1 AS due_date FROM omov m JOIN oahead h ON h.d = m.value_date")
cte(
    "obat0",
    """
SELECT account_id, bank_account_id, channel, due_date, max(close_date) AS batch_date, count(*) FILTER (type = 'CHARGE') AS n_charges,
       CAST(coalesce(sum(amount_cents) FILTER (type IN ('CHARGE', 'REFUND')), 0) AS BIGINT) AS gross_cents,
       CAST(abs(sum(amount_cents) FILTER (type = 'FEE')) AS BIGINT) AS fee_cents,
       CAST(abs(sum(amount_cents) FILTER (type = 'TAX')) AS BIGINT) AS tax_cents,
       CAST(abs(sum(amount_cents) FILTER (type = 'WITHHOLDING')) AS BIGINT) AS withholding_cents,
       row_number() OVER (PARTITION BY account_id ORDER BY due_date) AS o
FROM odue GROUP BY account_id, bank_account_id, channel, due_date""",
)
cte(
    "obat",
    """
SELECT 'bat_' || substr(sha256(account_id || '|' || CAST(batch_date AS VARCHAR)), 1, 16) AS batch_id, *,
       fee_cents + tax_cents + withholding_cents AS deductions_cents, 3 AS deduction_kinds,
       gross_cents - fee_cents - tax_cents - withholding_cents AS expected_net_cents, 0.02::DOUBLE AS band_lo, 0.08::DOUBLE AS band_hi FROM obat0""",
)
cte("ob2", "SELECT *, o % 8 AS kind, expected_net_cents AS net FROM obat")
cte(
    "ocred0",
    """
SELECT account_id, bank_account_id, o, kind, due_date AS value_date, net AS cents, 'DELTA PAY' AS counterparty, 'a' AS tag FROM ob2 WHERE kind IN (0, 4, 7)
UNION ALL SELECT account_id, bank_account_id, o, kind, due_date, (net * n * (n + 1)) // (m * (m + 1)) - (net * n * (n - 1)) // (m * (m + 1)), 'DELTA PAY', substr('abcdef', n, 1)
  FROM (SELECT *, 2 + (o // 8) % 5 AS m FROM ob2 WHERE kind = 1) s, (VALUES (1), (2), (3), (4), (5), (6)) p(n) WHERE n <= m
UNION ALL SELECT b.account_id, b.bank_account_id, b.o, b.kind, h.n1, b.net, 'DELTA PAY', 'a' FROM ob2 b JOIN oahead h ON h.d = b.due_date WHERE b.kind = 3
UNION ALL SELECT account_id, bank_account_id, o, kind, due_date, net, 'DELTA PAY', 'b' FROM ob2 WHERE kind = 4
UNION ALL SELECT account_id, bank_account_id, o, kind, due_date, net, 'OTHER PAYER', 'a' FROM ob2 WHERE kind = 5
UNION ALL SELECT account_id, bank_account_id, o, kind, due_date, net - 5000, 'DELTA PAY', 'a' FROM ob2 WHERE kind = 6""",
)
cte("ocred", CREDIT.format(source="ocred0", owner="CASE WHEN contains(counterparty, 'DELTA') THEN 'delta' END"))

# half a year of the orders, with the credits that may settle it
RUN_DAYS = "BETWEEN DATE '1997-01-01' AND DATE '1997-06-30'"
cte("rcal", "SELECT * FROM ocal")
cte("rahead", "SELECT * FROM oahead")
cte("rbat0", CTES["obat0"].replace("odue", f"(SELECT * FROM odue WHERE value_date {RUN_DAYS})"))
cte("rbat", CTES["obat"].replace("obat0", "rbat0"))
cte("rcred", "SELECT * FROM ocred WHERE value_date BETWEEN DATE '1997-01-01' AND (SELECT n3 FROM oahead WHERE d = DATE '1997-06-30')")

# journals
cte(
    "ent",
    """
SELECT 'e' || substr(id, 5) AS entry_id, account_id, id AS movement_id, external_id, amount_cents, event_id % 10 AS k, value_date FROM mov""",
)
cte(
    "erp_entries",
    """
SELECT entry_id, account_id AS journal_key, 'J/' || entry_id AS name, CASE WHEN k IN (0, 1, 2, 9) THEN upper(external_id) END AS ref,
       CASE WHEN k = 4 THEN value_date + 1 ELSE value_date END AS date, CASE WHEN k = 2 THEN 'draft' ELSE 'posted' END AS state,
       amount_cents + CASE WHEN k = 8 THEN 5000 ELSE 0 END AS entry_cents FROM ent WHERE k NOT IN (5, 6)
UNION ALL SELECT entry_id || 'd', account_id, 'J/' || entry_id || 'd', upper(external_id), value_date, 'posted', amount_cents FROM ent WHERE k = 9
UNION ALL SELECT entry_id || 'x', account_id, 'J/' || entry_id || 'x', NULL, value_date, 'posted', amount_cents + 777 FROM ent WHERE k = 5""",
)
