"""Sources, sinks, ingestion, scalar functions, statements, ledger, calendar."""

from oracle import base, cte, sql  # noqa: F401 - base defines the tables used below

cte(
    "gtx",
    """
SELECT event_id, event_id // 200 AS page, (event_id // 200) % 5 <> 4 AS whole, user_id, CAST(round(value * 100) AS BIGINT) * 1000 AS cents,
       CASE WHEN event_type = 'purchase' THEN 'APPROVED' WHEN event_id % 7 = 3 THEN NULL WHEN event_id % 2 = 0 THEN 'DECLINED' ELSE 'VOIDED' END AS status,
       CASE WHEN event_id % 4 <> 0 THEN ts + INTERVAL 1 HOUR ELSE ts END AS at_ts,
       CASE user_id % 3 WHEN 0 THEN 'CARD' WHEN 1 THEN 'PSE' END AS method
FROM events WHERE event_type IN ('purchase', 'error')""",
)
cte(
    "gcharge",
    """
SELECT 'mov_' || substr(sha256('gateway|evt-' || event_id || '|' || CAST(CAST(at_ts - INTERVAL 5 HOUR AS DATE) AS VARCHAR) || '|' || cents || '|CHARGE|tx-' || event_id), 1, 16) AS id,
       'evt-' || event_id AS external_id, epoch_us(at_ts) AS occurred_us, CAST(CAST(at_ts - INTERVAL 5 HOUR AS DATE) AS VARCHAR) AS value_date, 'CHARGE' AS type,
       cents AS amount_cents, 'GATEWAY S.A.S.' AS counterparty, trim('Pago aprobado ' || coalesce(method, '')) AS description,
       coalesce(method, 'UNKNOWN') AS method, 'tx-' || event_id AS locator, page
FROM gtx WHERE whole AND status = 'APPROVED'""",
)
cte(
    "stm0",
    """
SELECT 'stm:' || left(o_orderpriority, 1) || ':' || strftime(o_orderdate, '%Y-%m') || ':' || (o_custkey // 1500) AS raw_id, CAST(o_orderdate AS DATE) AS day, o_orderkey AS k, o_custkey,
       CASE WHEN o_orderstatus = 'P' THEN -1 ELSE 1 END * CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS cents,
       CASE o_orderkey % 3 WHEN 0 THEN 'PAGO DE PROV CLIENTE ' || o_custkey WHEN 1 THEN 'CUOTA DE MANEJO' ELSE 'pago de terc DELTA PAY' END AS description
FROM orders""",
)
cte(
    "stm1",
    """
SELECT *, row_number() OVER w AS n, CAST(1000000000 + sum(cents) OVER w AS BIGINT) AS balance, substr(raw_id, 12, 2) AS mm, substr(raw_id, 7, 4) AS yy
FROM stm0 WINDOW w AS (PARTITION BY raw_id ORDER BY day, k)""",
)
cte(
    "stm",
    """
SELECT *, (n - 1) // 20 + 1 AS page, 700 - 12 * ((n - 1) % 20) AS y, balance + CASE WHEN mm = '02' AND n = 2 THEN 1 ELSE 0 END AS printed FROM stm1""",
)
cte(
    "stmdoc",
    """
SELECT raw_id, any_value(mm) AS mm, any_value(yy) AS yy, count(*) AS entries, arg_max(balance, n) AS closing, '9990' || substr(raw_id, 5, 1) AS account_number,
       CAST(coalesce(sum(cents) FILTER (cents > 0), 0) AS BIGINT) AS credits, CAST(coalesce(-sum(cents) FILTER (cents < 0), 0) AS BIGINT) AS debits
FROM stm GROUP BY raw_id""",
)


def amount_text(cents: str) -> str:
    return f"(format('{{:,}}', ({cents}) // 100) || '.' || lpad(CAST(({cents}) % 100 AS VARCHAR), 2, '0'))"


cte(
    "stmline",
    f"""
SELECT raw_id, page, y, n, day(day) || '/' || mm AS d, description,
       CASE WHEN cents < 0 THEN {amount_text('-cents')} || '-' ELSE {amount_text('cents')} END AS v,
       CASE WHEN printed < 0 THEN '-' || {amount_text('-printed')} ELSE {amount_text('printed')} END AS b FROM stm""",
)
cte(
    "stmverdict",
    """
SELECT d.raw_id, d.account_number, d.entries, CASE WHEN d.mm IN ('02', '03', '04') AND NOT (d.mm = '02' AND d.entries = 1) THEN false ELSE true END AS accepted,
       CASE WHEN d.mm = '02' AND d.entries > 1 THEN 'CHAIN_BREAKS' WHEN d.mm = '03' THEN 'NO_CLOSING' WHEN d.mm = '04' THEN 'TOTALS_DISAGREE' ELSE '' END AS reason,
       CASE WHEN d.mm = '02' AND d.entries > 1 THEN 'page=1;y=688' ELSE '' END AS locator,
       CAST(CASE WHEN d.mm = '02' AND d.entries > 1 THEN (SELECT balance FROM stm s WHERE s.raw_id = d.raw_id AND s.n = 2) WHEN d.mm = '04' THEN credits + 100 ELSE 0 END AS BIGINT) AS expected_cents,
       CAST(CASE WHEN d.mm = '02' AND d.entries > 1 THEN (SELECT balance + 1 FROM stm s WHERE s.raw_id = d.raw_id AND s.n = 2) WHEN d.mm = '04' THEN credits ELSE 0 END AS BIGINT) AS observed_cents
FROM stmdoc d""",
)

PAGE_NAME = """
'dir/' || source || ' é#' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PDF' ELSE '.txt' END"""
SAFE_NAME = "source || ' _' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PDF' ELSE '.txt' END"
BODY = "CASE WHEN doc_id % 2 = 0 THEN '%PDF' || text ELSE text END"
OWN = "(event_id % 7 = 0)"
DESCRIBED = """
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'PAGO DE PROV ' || source WHEN 1 THEN ' pago de terc ' || lang || ' ' WHEN 2 THEN 'PAGO DE PROV '
       WHEN 3 THEN 'PAGO DE  PROV ' || lang ELSE text END AS t, source, lang FROM documents"""
cte("described", DESCRIBED)

RULE = """CASE WHEN starts_with(upper(trim(t)), 'PAGO DE PROV ') THEN 'supplier-payment-in' WHEN starts_with(upper(trim(t)), 'PAGO DE TERC ') THEN 'third-party-payment-in' ELSE 'fallback' END"""
FULL_YEAR = "(SELECT CAST(d AS DATE) AS d FROM cal0)"


def policy_words() -> str:
    return "CASE channel WHEN 'alpha' THEN 'corte diario' WHEN 'beta' THEN 'corte semanal (cierra domingo)' ELSE 'corte mensual (cierra el día 31)' END"


CHANNELS = "(VALUES ('alpha'), ('beta'), ('gamma')) c(channel)"
cte("parties0", "SELECT upper(channel) || ' S.A.S.' AS counterparty FROM mov UNION ALL SELECT counterparty FROM cred")
cte("named", f"SELECT counterparty, channel, rows FROM (SELECT counterparty, count(*) AS rows FROM parties0 GROUP BY counterparty) CROSS JOIN {CHANNELS}")
cte(
    "figures",
    """
SELECT * FROM (
  SELECT 'read' AS figure, 'raw_records' AS name, count(DISTINCT page) AS n FROM gtx
  UNION ALL SELECT 'movements', 'inserted', count(*) FILTER (amount_cents % 2000 <> 0) FROM gcharge
  UNION ALL SELECT 'movements', 'updated', count(*) FILTER (amount_cents % 2000 = 0) FROM gcharge
  UNION ALL SELECT 'type', 'CHARGE', count(*) FROM gcharge
  UNION ALL SELECT 'rejected', CASE page % 10 WHEN 4 THEN 'UNKNOWN_LAYOUT' ELSE 'PARSE_INTEGRITY' END, count(DISTINCT page) FROM gtx WHERE NOT whole GROUP BY 2) WHERE n > 0 OR figure IN ('read', 'movements')""",
)


def scaled(rounding: str) -> str:
    whole, rest, den = "(p // den)", "(p % den)", "den"
    bump = {
        "truncate": "0",
        "half_up": f"CASE WHEN {rest} * 2 >= {den} THEN 1 ELSE 0 END",
        "half_even": f"CASE WHEN {rest} * 2 > {den} THEN 1 WHEN {rest} * 2 < {den} THEN 0 ELSE {whole} % 2 END",
    }[rounding]
    return f"CAST(CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * ({whole} + {bump}) AS BIGINT) AS {rounding}"


PARSE = """
SELECT o_orderkey, CAST(CASE o_orderkey % 12 WHEN 0 THEN c WHEN 1 THEN -c WHEN 2 THEN -c WHEN 3 THEN -c WHEN 4 THEN c WHEN 5 THEN -c WHEN 11 THEN (c // 100) * 100 ELSE 0 END AS BIGINT) AS cents,
       CASE o_orderkey % 12 WHEN 6 THEN 'EMPTY' WHEN 7 THEN 'MANY_DECIMAL_MARKS' WHEN 8 THEN 'NON_NUMERIC' WHEN 9 THEN 'MANY_DECIMALS' WHEN 10 THEN 'TOO_LARGE' ELSE '' END AS error
FROM ocents"""


def money_text(cents: str) -> str:
    """The shown form of a signed amount."""
    digits = f"lpad(CAST(abs({cents}) AS VARCHAR), CAST(greatest(3, length(CAST(abs({cents}) AS VARCHAR))) AS INTEGER), '0')"
    return (
        f"(CASE WHEN {cents} < 0 THEN '-' ELSE '' END || '$' || replace(format('{{:,}}', abs({cents}) // 100), ',', '.') || ',' || right({digits}, 2))"
    )


SIGNED = "CASE WHEN o_orderstatus = 'P' THEN -c WHEN o_orderkey % 50 = 0 THEN c % 7 ELSE c END"

ORACLE = {
    "src_gateway_pages": "SELECT CAST(page AS BIGINT) AS page, 'tx-' || event_id AS tx_id, cents AS amount_cents, status FROM gtx WHERE whole",
    "src_inbox": "SELECT url AS origin, sha256(html) AS content_hash, 'raw_' || substr(sha256('inbox|' || sha256(html)), 1, 16) AS raw_id FROM pages",
    "src_inbox_list": f"SELECT source || ' é#' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.pdf' ELSE '.PDF' END AS name, CAST(strlen({BODY}) AS BIGINT) AS bytes FROM documents WHERE doc_id % 3 < 2",
    "src_admit": f"""SELECT doc_id, {SAFE_NAME} AS name, (doc_id % 3 < 2 AND (doc_id % 2 = 0 OR starts_with(text, '%PDF'))) AS admitted,
        CASE WHEN doc_id % 3 = 2 THEN 'EXTENSION_NOT_ACCEPTED' WHEN doc_id % 2 = 0 THEN '' ELSE 'NOT_A_PDF' END AS reason FROM documents""",
    "src_route": "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'gateway-transactions' WHEN 1 THEN 'bank-statement' ELSE 'UNKNOWN_LAYOUT' END AS parser FROM documents",
    "src_journal": """SELECT o_orderkey AS entry_id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date, 2::BIGINT AS lines, 0::BIGINT AS signed_cents,
        2 * CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS moved_cents FROM orders WHERE o_orderdate >= '1996-01-01' AND o_orderdate < '1999-01-01'""",
    "src_journal_norm": """SELECT o_orderkey AS entry_id, CASE WHEN o_orderstatus = 'O' THEN '(borrador sin numerar)' ELSE 'ORD/' || o_orderkey END AS name,
        CASE WHEN o_orderstatus = 'F' THEN '' ELSE 'Ord-' || o_orderkey END AS ref, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date,
        CASE o_orderstatus WHEN 'F' THEN 'posted' WHEN 'P' THEN 'cancel' ELSE 'draft' END AS state, o_orderkey * 2 + s AS line_id,
        CASE s WHEN 0 THEN '2000010' ELSE '700100' END AS account_code, CASE s WHEN 0 THEN 'Main account' ELSE 'Other sales' END AS account_name,
        CASE s WHEN 0 THEN 1 ELSE -1 END * CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS amount_cents FROM orders CROSS JOIN (VALUES (0), (1)) v(s)""",
    "src_own_entries": f"""SELECT 'o' || substr(id, 5) AS entry_id, 'mov:' || id AS ref, CAST(value_date AS VARCHAR) AS date,
        CASE WHEN amount_cents % 4000 = 0 THEN 'draft' ELSE 'posted' END AS state FROM mov WHERE {OWN}""",
    "src_find_by_ref": """SELECT ref, arg_min(entry_id, (date, entry_id)) AS entry_id, CAST(min(date) AS VARCHAR) AS date FROM erp_entries WHERE ref IS NOT NULL GROUP BY ref""",
    "snk_raw_upsert": """SELECT 'raw_' || substr(sha256('inbox|' || h), 1, 16) AS raw_id, h AS content_hash, CASE WHEN left(h, 1) >= '5' THEN 'run_2' ELSE 'run_1' END AS run_id
        FROM (SELECT DISTINCT sha256(text) AS h FROM documents)""",
    "snk_mov_upsert": "SELECT id, CASE WHEN event_id % 3 = 1 THEN 'run_1' ELSE 'run_2' END AS run_id, amount_cents FROM mov",
    "snk_mov_upsert_counts": "SELECT count(*) FILTER (event_id % 3 = 0) AS inserted, count(*) FILTER (event_id % 3 = 2) AS updated FROM mov",
    "snk_run": """SELECT 'run_' || strftime(d, '%Y%m%d') || '000000' AS run_id, CASE WHEN day(d) % 2 = 0 THEN 0 ELSE n END AS events
        FROM (SELECT date_trunc('day', ts) AS d, count(*) AS n FROM events GROUP BY 1) ORDER BY d DESC LIMIT 20""",
    "run_resolve": """SELECT 'run_' || strftime(max(ts), '%Y%m%d') || '000000' AS run_id, 'latest' AS wanted FROM events
        UNION ALL SELECT DISTINCT 'run_20240105000000', 'known' FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-05'""",
    "ing_gateway_charge": "SELECT id, external_id, occurred_us, value_date, type, amount_cents, counterparty, description, method, locator FROM gcharge",
    "ing_excluded": "SELECT 'page=' || page AS origin, status, count(*) AS transactions FROM gtx WHERE whole AND status IS DISTINCT FROM 'APPROVED' GROUP BY page, status",
    "ing_shape_check": "SELECT DISTINCT 'page=' || page AS origin, 'PARSE_INTEGRITY' AS code FROM gtx WHERE page % 10 = 9",
    "ing_parse_amount": PARSE,
    "ing_major_units": "SELECT l_orderkey, l_linenumber, CAST(sum(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) AS BIGINT) AS cents FROM lineitem GROUP BY ALL",
    "ing_classify": f"SELECT doc_id, CASE WHEN {RULE} = 'fallback' THEN 'OTHER' ELSE 'TRANSFER_IN' END AS type, {RULE} AS rule, {RULE} <> 'fallback' AS recognised FROM described",
    "ing_counterparty": f"SELECT doc_id, CASE WHEN {RULE} = 'fallback' THEN '' ELSE trim(substr(trim(t), 14)) END AS counterparty FROM described",
    "ing_ids": "SELECT id, account_id, external_id, CAST(value_date AS VARCHAR) AS value_date, amount_cents FROM mov",
    "ing_pipeline": """
        SELECT 'page=' || page AS origin, CASE page % 10 WHEN 4 THEN 'none' ELSE 'gateway-transactions' END AS parser,
               CASE page % 10 WHEN 4 THEN 'UNKNOWN_LAYOUT' WHEN 9 THEN 'PARSE_INTEGRITY' ELSE 'ACCEPTED' END AS outcome, count(*) FILTER (whole AND status = 'APPROVED') AS movements FROM gtx GROUP BY page
        UNION ALL SELECT raw_id, 'bank-statement', CASE WHEN accepted THEN 'ACCEPTED' ELSE reason END, CASE WHEN accepted THEN entries ELSE 0 END FROM stmverdict""",
    "ing_report": "SELECT figure, name, n FROM figures",
    "fn_scale": f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {scaled('truncate')}, {scaled('half_up')}, {scaled('half_even')} FROM
        (SELECT *, CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS HUGEINT) * CAST(l_quantity AS INTEGER) AS p, l_linenumber * 7 + 3 AS den FROM lineitem)""",
    "fn_money_format": f"SELECT o_orderkey, {money_text(SIGNED)} AS text FROM ocents",
    "fn_humanise": f"SELECT o_orderkey, 'delta ' || {money_text('(-c)')} || ' sobre ' || {money_text('c')} || '; COP x' AS text FROM ocents",
    "stm_rows": f"""
        SELECT raw_id, page, y, d || ' ' || description || ' ' || v || ' ' || b AS line, 4 AS cells FROM stmline
        UNION ALL SELECT raw_id, 0, 800, 'DESDE: ' || yy || '/' || mm || '/01 HASTA: ' || yy || '/' || mm || '/' || strftime(last_day(CAST(yy || '-' || mm || '-01' AS DATE)), '%d'), 1 FROM stmdoc
        UNION ALL SELECT raw_id, 0, 780, 'NÚMERO ' || account_number, 2 FROM stmdoc
        UNION ALL SELECT raw_id, 0, 760, 'SALDO ANTERIOR $10,000,000.00', 2 FROM stmdoc
        UNION ALL SELECT raw_id, 0, 740, 'SALDO ACTUAL ' || {amount_text('closing')}, 2 FROM stmdoc WHERE mm <> '03'
        UNION ALL SELECT raw_id, 0, 720, 'TOTAL ABONOS ' || {amount_text("(credits + CASE WHEN mm = '04' THEN 100 ELSE 0 END)")}, 2 FROM stmdoc WHERE mm <> '05'
        UNION ALL SELECT raw_id, 0, 720, 'Ver TOTAL ABONOS', 1 FROM stmdoc WHERE mm = '05'
        UNION ALL SELECT raw_id, 0, 710, {amount_text('credits')}, 1 FROM stmdoc WHERE mm = '05'
        UNION ALL SELECT raw_id, 0, 700, 'TOTAL CARGOS ' || {amount_text('debits')}, 2 FROM stmdoc""",
    "stm_columns": "SELECT raw_id, page, y, d AS date, description, v AS value, b AS balance FROM stmline",
    "stm_header": """SELECT raw_id, account_number, yy || '-' || mm || '-01' AS from_date, CAST(last_day(CAST(yy || '-' || mm || '-01' AS DATE)) AS VARCHAR) AS to_date FROM stmdoc""",
    "stm_summary": """SELECT raw_id, 1000000000::BIGINT AS opening_cents, CASE WHEN mm = '03' THEN 0 ELSE closing END AS closing_cents,
        credits + CASE WHEN mm = '04' THEN 100 ELSE 0 END AS credits_cents, debits AS debits_cents, CASE WHEN mm = '03' THEN 'CLOSING' ELSE '' END AS missing FROM stmdoc""",
    "stm_entries": "SELECT raw_id, 'page=' || page || ';y=' || y AS locator, description, cents AS amount_cents, printed AS balance_cents FROM stm",
    "stm_year": "SELECT raw_id, CAST(day AS VARCHAR) AS value_date, count(*) AS entries FROM stm GROUP BY raw_id, day",
    "stm_chain": """SELECT raw_id, 'page=' || page || ';y=' || y AS locator, coalesce(lag(printed) OVER w, 1000000000) + cents AS expected_cents, printed AS balance_cents,
        coalesce(lag(printed) OVER w, 1000000000) + cents <> printed AS breaks FROM stm WINDOW w AS (PARTITION BY raw_id ORDER BY n)""",
    "stm_totals": "SELECT raw_id, entries, accepted, reason, locator, expected_cents, observed_cents FROM stmverdict",
    "stm_unknown": "SELECT DISTINCT raw_id, description FROM stm WHERE k % 3 = 1",
    "stm_to_movement": """
        SELECT 'mov_' || substr(sha256('statement||' || CAST(day AS VARCHAR) || '|' || cents || '|' || CASE WHEN k % 3 = 1 THEN 'OTHER' ELSE 'TRANSFER_IN' END || '|page=' || page || ';y=' || y), 1, 16) AS id,
               'bank:' || v.account_number AS account_id, epoch_us(CAST(day AS TIMESTAMP) + INTERVAL 5 HOUR) AS occurred_us, CAST(day AS VARCHAR) AS value_date,
               CASE WHEN k % 3 = 1 THEN 'OTHER' ELSE 'TRANSFER_IN' END AS type, cents AS amount_cents,
               CASE k % 3 WHEN 0 THEN 'CLIENTE ' || o_custkey WHEN 1 THEN '' ELSE 'DELTA PAY' END AS counterparty,
               CASE k % 3 WHEN 0 THEN 'supplier-payment-in' WHEN 1 THEN 'fallback' ELSE 'third-party-payment-in' END AS rule,
               CAST(printed AS VARCHAR) AS running_balance, 'page=' || page || ';y=' || y AS locator
        FROM stm JOIN stmverdict v USING (raw_id) WHERE v.accepted""",
    "led_by_account": "SELECT id, account_id, CAST(value_date AS VARCHAR) AS value_date, amount_cents FROM mov WHERE account_id = 'gw:3' AND value_date BETWEEN '2024-01-05' AND '2024-01-20'",
    "led_by_ids": "SELECT id, external_id FROM mov WHERE account_id = 'gw:1'",
    "led_by_external": "SELECT id, type, amount_cents FROM omov WHERE external_id = 'ord-100'",
    "led_by_type": "SELECT account_id, type, count(*) AS n, CAST(sum(amount_cents) AS BIGINT) AS cents FROM omov WHERE type IN ('FEE', 'TAX') GROUP BY ALL",
    "led_between": "SELECT id, CAST(value_date AS VARCHAR) AS value_date, amount_cents FROM omov WHERE value_date BETWEEN '1997-03-01' AND '1997-03-31'",
    "led_count": "SELECT account_id, count(*) AS movements FROM (SELECT account_id FROM mov UNION ALL SELECT account_id FROM omov) GROUP BY 1",
    "led_total": "SELECT account_id, CAST(sum(amount_cents) AS BIGINT) AS total_cents FROM omov GROUP BY 1",
    "led_balance_at": "SELECT account_id, CAST(sum(amount_cents) AS BIGINT) AS balance_cents FROM omov WHERE value_date <= '1998-06-30' GROUP BY 1",
    "led_daily_balance": """SELECT account_id, CAST(value_date AS VARCHAR) AS value_date, movements, CAST(sum(day_cents) OVER (PARTITION BY account_id ORDER BY value_date) AS BIGINT) AS balance_cents
        FROM (SELECT account_id, value_date, count(*) AS movements, sum(amount_cents) AS day_cents FROM omov GROUP BY 1, 2)""",
    "led_page": """SELECT id, CAST(value_date AS VARCHAR) AS value_date, (SELECT count(*) FROM mov) AS total,
        CASE WHEN (SELECT count(*) FROM mov) > 75 THEN last_value(id) OVER (ORDER BY value_date, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) END AS next_cursor
        FROM (SELECT * FROM mov ORDER BY value_date, id LIMIT 25 OFFSET 50)""",
    "led_balance_stored": "SELECT account_id, CAST(sum(amount_cents) AS BIGINT) AS balance_cents FROM omov WHERE value_date <= '1998-06-30' GROUP BY 1",
    "led_page_stored": """SELECT id, CAST(value_date AS VARCHAR) AS value_date, (SELECT count(*) FROM mov) AS total,
        CASE WHEN (SELECT count(*) FROM mov) > 75 THEN last_value(id) OVER (ORDER BY value_date, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) END AS next_cursor
        FROM (SELECT * FROM mov ORDER BY value_date, id LIMIT 25 OFFSET 50)""",
    "led_accounts": "SELECT DISTINCT account_id FROM mov UNION SELECT DISTINCT account_id FROM omov",
    "cal_dim": "SELECT CAST(value_date AS VARCHAR) AS d, count(*) AS movements, any_value(is_bd) AS is_business FROM mov JOIN cal ON cal.d = value_date GROUP BY value_date",
    "cal_next": """SELECT CAST(d AS VARCHAR) AS d, n, CAST(CASE n WHEN 1 THEN n1 WHEN 2 THEN n2 ELSE n3 END AS VARCHAR) AS next
        FROM ahead CROSS JOIN (VALUES (1), (2), (3)) v(n) WHERE d IN (SELECT value_date FROM mov)""",
    "cal_between": """SELECT CAST(a.d AS VARCHAR) AS d, CAST(b.d AS VARCHAR) AS other, CASE WHEN b.d < a.d THEN -1 ELSE b.ord - a.ord END AS business_days
        FROM cal a CROSS JOIN (VALUES (-1), (0), (4), (9)) v(n) JOIN cal b ON b.d = a.d + n WHERE a.d IN (SELECT value_date FROM mov)""",
    "cal_window": "SELECT batch_id, CAST(batch_date AS VARCHAR) AS batch_date, CAST(n1 AS VARCHAR) AS window_start, CAST(n3 AS VARCHAR) AS window_end FROM bat JOIN ahead ON d = batch_date",
    "pol_accrual": "SELECT id, CAST(accrual_date AS VARCHAR) AS accrual_date FROM acc",
    "pol_close": "SELECT id, channel, CAST(close_date AS VARCHAR) AS close_date FROM acc",
    "pol_due": "SELECT id, CAST(due_date AS VARCHAR) AS due_date FROM due",
    "pol_for_channel": """SELECT channel, count(*) AS movements, CASE channel WHEN 'alpha' THEN 'DAILY' WHEN 'beta' THEN 'WEEKLY' ELSE 'MONTHLY' END AS cadence,
        CASE channel WHEN 'alpha' THEN 1260 ELSE -1 END AS cutoff_minutes, 1 AS window_from, 3 AS window_to, CASE channel WHEN 'gamma' THEN 0.02 ELSE 0.04 END::DOUBLE AS band_lo,
        CASE channel WHEN 'gamma' THEN 0.08 ELSE 0.05 END::DOUBLE AS band_hi, 19 AS vat_num, 15 AS wh_num, channel <> 'gamma' AS own_band FROM mov GROUP BY channel""",
    "pol_describe": f"SELECT channel, count(*) AS movements, {policy_words()} AS cadence FROM mov GROUP BY channel",
    "pred_channel": "SELECT counterparty, rows, channel, contains(counterparty, upper(channel)) AS is_channel FROM named",
    "pred_foreign": "SELECT counterparty, rows, channel, NOT contains(counterparty, upper(channel)) AND counterparty <> 'OTHER PAYER' AS is_foreign FROM named",
    "pred_owner": "SELECT deposit_id AS id, coalesce(owner, '') AS owner FROM cred",
}
ORACLE = {name: sql(body) for name, body in ORACLE.items()}
