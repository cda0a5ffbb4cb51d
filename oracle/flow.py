"""Batches, candidates, evidence, assignment, deductions, results, lineage."""

from oracle import base, cte, sql  # noqa: F401 - base defines the tables used below

GATES = "('AMOUNT_MISMATCH', 'DESCRIPTOR_FOREIGN', 'DATE_OUT_OF_WINDOW')"
FAILED = (
    "('AMOUNT_MISMATCH', 'DATE_OUT_OF_WINDOW', 'DESCRIPTOR_FOREIGN', 'IDENTITY_BROKEN', 'SETTLEMENT_SPLIT', 'SETTLEMENT_MERGED',"
    " 'SUBSET_SUM_MULTIPLE', 'UNRESOLVED_COMBINATORIAL', 'COMPETING_CANDIDATE')"
)


def amount_code(observed: str) -> str:
    return f"""CASE WHEN {observed} = expected_net_cents THEN 'AMOUNT_EXACT' WHEN abs({observed} - expected_net_cents) <= 10000 THEN 'AMOUNT_WITHIN_ROUNDING'
        WHEN deduction_kinds = 0 AND gross_cents > 0 AND (gross_cents - {observed})::DOUBLE / gross_cents::DOUBLE BETWEEN band_lo AND band_hi THEN 'IMPLIED_FEE_IN_BAND'
        ELSE 'AMOUNT_MISMATCH' END"""


def date_code(gap: str) -> str:
    return f"CASE WHEN {gap} = 1 THEN 'DATE_T1_EXACT' WHEN {gap} BETWEEN 1 AND 3 THEN 'DATE_IN_WINDOW' ELSE 'DATE_OUT_OF_WINDOW' END"


IDENTITY = "CASE WHEN deduction_kinds > 0 THEN 'IDENTITY_HOLDS' ELSE 'IDENTITY_BROKEN' END"


def weight(code: str) -> str:
    return f"""CASE {code} WHEN 'AMOUNT_EXACT' THEN 50 WHEN 'IMPLIED_FEE_TYPICAL' THEN 40 WHEN 'AMOUNT_WITHIN_ROUNDING' THEN 25 WHEN 'IMPLIED_FEE_IN_BAND' THEN 25
        WHEN 'DATE_T1_EXACT' THEN 25 WHEN 'DATE_IN_WINDOW' THEN 15 WHEN 'DESCRIPTOR_MATCH' THEN 15 WHEN 'IDENTITY_HOLDS' THEN 10
        WHEN 'SETTLEMENT_SINGLE_CREDIT' THEN 25 WHEN 'UNIQUE_CANDIDATE' THEN 10 ELSE 0 END"""


CODES = ("amount_code", "date_code", "descriptor_code", "identity_code", "shape_code", "multiple_code")
EARNED = " + ".join(f"({weight(c)})" for c in CODES)
FIRST_FAILED = "coalesce(" + ", ".join(f"CASE WHEN {c} IN {FAILED} THEN {c} END" for c in CODES) + ")"
GATE = "coalesce(" + ", ".join(f"CASE WHEN {c} IN {GATES} THEN {c} END" for c in CODES) + ")"


def score(earned: str, attainable: str) -> str:
    return f"(200 * ({earned}) + {attainable}) // (2 * {attainable})"


for p in ("", "o", "r"):
    # within the window and not another channel's; the owner of a credit is at most one channel here
    cte(
        f"{p}elig",
        f"""
SELECT b.batch_id, b.account_id, b.batch_date, b.gross_cents, b.expected_net_cents, b.deductions_cents, b.deduction_kinds, b.band_lo, b.band_hi, b.n_charges,
       c.deposit_id, c.value_date, c.cents, x.ord - h.ord AS gap, coalesce(c.owner = b.channel, false) AS names_channel
FROM {p}bat b JOIN {p}ahead h ON h.d = b.batch_date
JOIN {p}cred c ON c.bank_account_id = b.bank_account_id AND c.value_date BETWEEN h.n1 AND h.n3 JOIN {p}cal x ON x.d = c.value_date
WHERE c.cents > 0 AND (c.owner IS NULL OR c.owner = b.channel)""",
    )
    cte(
        f"{p}target",
        f"""
SELECT *, CASE WHEN deduction_kinds > 0 THEN expected_net_cents ELSE CAST(floor(gross_cents::DOUBLE * (1 - (band_lo + band_hi) / 2) + 0.5) AS BIGINT) END AS target_cents,
       CASE WHEN deduction_kinds > 0 THEN 100 ELSE CAST(floor(gross_cents::DOUBLE * (band_hi - band_lo) / 2 + 0.5) AS BIGINT) END AS slack_cents FROM {p}bat""",
    )
    cte(
        f"{p}single",
        f"""
SELECT account_id, batch_id, 1 AS rule, deposit_id AS key, [deposit_id] AS deposit_ids, 1 AS n_deposits, cents AS observed_cents, value_date AS first_date,
       {amount_code('cents')} AS amount_code, {date_code('gap')} AS date_code, CASE WHEN names_channel THEN 'DESCRIPTOR_MATCH' ELSE 'DESCRIPTOR_FOREIGN' END AS descriptor_code,
       {IDENTITY} AS identity_code, 'SETTLEMENT_SINGLE_CREDIT' AS shape_code, NULL::VARCHAR AS multiple_code, NULL::BIGINT AS solutions,
       NULL::DATE AS merged_with, NULL::VARCHAR AS merged_deposit, NULL::DOUBLE AS merged_rate FROM {p}elig""",
    )
    cte(
        f"{p}srt",
        f"""
SELECT e.batch_id, e.deposit_id, e.cents, t.target_cents, t.slack_cents, count(*) OVER (PARTITION BY e.batch_id) AS n_all,
       row_number() OVER w AS pos, sum(e.cents) OVER (PARTITION BY e.batch_id ORDER BY e.cents DESC, e.value_date, e.deposit_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS rest
FROM {p}elig e JOIN {p}target t USING (batch_id) WINDOW w AS (PARTITION BY e.batch_id ORDER BY e.cents DESC, e.value_date, e.deposit_id)""",
    )
    cte(
        f"{p}sub",
        f"""
SELECT batch_id, [pos] AS path, [deposit_id] AS deposits, pos AS last, target_cents - cents AS missing, slack_cents, coalesce(rest, 0) AS rest FROM {p}srt
WHERE n_all >= 2 AND target_cents - cents >= -slack_cents AND cents + coalesce(rest, 0) >= target_cents - slack_cents
UNION ALL
SELECT s.batch_id, list_append(s.path, c.pos), list_append(s.deposits, c.deposit_id), c.pos, s.missing - c.cents, s.slack_cents, coalesce(c.rest, 0)
FROM {p}sub s JOIN {p}srt c ON c.batch_id = s.batch_id AND c.pos > s.last
WHERE abs(s.missing) > s.slack_cents AND s.missing - c.cents >= -s.slack_cents AND c.cents + coalesce(c.rest, 0) >= s.missing - s.slack_cents AND len(s.path) < 60""",
    )
    cte(
        f"{p}sol",
        f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY path) AS solution FROM {p}sub WHERE abs(missing) <= slack_cents) WHERE solution <= 5""",
    )
    cte(
        f"{p}parts",
        f"""
SELECT s.batch_id, s.solution, e.*EXCLUDE (batch_id) FROM (SELECT batch_id, solution, unnest(deposits) AS deposit_id FROM {p}sol WHERE len(path) > 1) s
JOIN {p}elig e ON e.batch_id = s.batch_id AND e.deposit_id = s.deposit_id""",
    )
    cte(
        f"{p}sums",
        f"""
SELECT batch_id, solution, any_value(account_id) AS account_id, any_value(gross_cents) AS gross_cents, any_value(expected_net_cents) AS expected_net_cents,
       any_value(deduction_kinds) AS deduction_kinds, any_value(band_lo) AS band_lo, any_value(band_hi) AS band_hi, list(deposit_id ORDER BY value_date, deposit_id) AS deposit_ids,
       string_agg(deposit_id, '+' ORDER BY deposit_id) AS key, count(*) AS n_deposits, CAST(sum(cents) AS BIGINT) AS observed_cents, min(value_date) AS first_date, min(gap) AS gap,
       bool_and(names_channel) AS names_channel, count(*) OVER (PARTITION BY batch_id) AS solutions FROM {p}parts GROUP BY batch_id, solution""",
    )
    cte(
        f"{p}split",
        f"""
SELECT account_id, batch_id, 2 AS rule, key, deposit_ids, n_deposits, observed_cents, first_date, {amount_code('observed_cents')} AS amount_code, {date_code('gap')} AS date_code,
       CASE WHEN names_channel THEN 'DESCRIPTOR_MATCH' ELSE 'DESCRIPTOR_FOREIGN' END AS descriptor_code, {IDENTITY} AS identity_code, 'SETTLEMENT_SPLIT' AS shape_code,
       CASE WHEN solutions > 1 THEN 'SUBSET_SUM_MULTIPLE' END AS multiple_code, solutions, NULL::DATE AS merged_with, NULL::VARCHAR AS merged_deposit, NULL::DOUBLE AS merged_rate FROM {p}sums""",
    )
    cte(
        f"{p}near",
        f"""
SELECT b.batch_id, b.account_id, b.band_lo, b.band_hi, o.batch_id AS other_id, o.batch_date AS other_date, b.gross_cents + o.gross_cents AS combined
FROM {p}bat b JOIN {p}bat o ON o.account_id = b.account_id AND o.batch_id <> b.batch_id AND abs(o.batch_date - b.batch_date) <= 5""",
    )
    cte(
        f"{p}reachable",
        f"""
SELECT DISTINCT n.batch_id, e.deposit_id, e.value_date, e.cents FROM {p}near n JOIN {p}elig e ON e.batch_id = n.batch_id OR e.batch_id = n.other_id""",
    )
    cte(
        f"{p}fits",
        f"""
SELECT n.batch_id, n.account_id, n.other_date, r.deposit_id, 1 - r.cents::DOUBLE / n.combined::DOUBLE AS rate,
       row_number() OVER (PARTITION BY n.batch_id ORDER BY abs(1 - r.cents::DOUBLE / n.combined::DOUBLE - (band_lo + band_hi) / 2), r.value_date, r.deposit_id, n.other_date) AS rn
FROM {p}near n JOIN {p}reachable r USING (batch_id) WHERE n.combined > 0 AND 1 - r.cents::DOUBLE / n.combined::DOUBLE BETWEEN band_lo AND band_hi""",
    )
    cte(
        f"{p}merged",
        f"""
SELECT account_id, batch_id, 3 AS rule, '' AS key, []::VARCHAR[] AS deposit_ids, 0 AS n_deposits, 0::BIGINT AS observed_cents, NULL::DATE AS first_date, NULL::VARCHAR AS amount_code,
       NULL::VARCHAR AS date_code, NULL::VARCHAR AS descriptor_code, NULL::VARCHAR AS identity_code, 'SETTLEMENT_MERGED' AS shape_code, NULL::VARCHAR AS multiple_code,
       NULL::BIGINT AS solutions, other_date AS merged_with, deposit_id AS merged_deposit, rate AS merged_rate FROM {p}fits WHERE rn = 1""",
    )
    cte(f"{p}cand0", f"SELECT * FROM {p}single UNION ALL SELECT * FROM {p}split UNION ALL SELECT * FROM {p}merged")
    cte(
        f"{p}cand1",
        f"""
SELECT c.*, b.deduction_kinds, {EARNED} AS earned, 135 - CASE WHEN c.identity_code = 'IDENTITY_BROKEN' AND b.deduction_kinds = 0 THEN 10 ELSE 0 END AS attainable
FROM {p}cand0 c JOIN {p}bat b USING (batch_id)""",
    )
    cte(f"{p}cand", f"SELECT *, {score('earned', 'attainable')} AS score, {GATE} AS gate, {FIRST_FAILED} AS first_failed FROM {p}cand1")
    cte(f"{p}pairs", f"SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY score DESC, batch_id, n_deposits, key) AS rk FROM {p}cand WHERE n_deposits > 0 AND gate IS NULL")
    # one pair per account and step, best first; a pair is won when nothing it claims is taken
    cte(
        f"{p}greedy",
        f"""
SELECT account_id, CAST(0 AS BIGINT) AS rk, ''::VARCHAR AS batch_id, ''::VARCHAR AS key, false AS won, []::VARCHAR[] AS taken FROM {p}pairs WHERE rk = 1
UNION ALL
SELECT g.account_id, q.rk, q.batch_id, q.key, NOT list_has_any(g.taken, list_append(q.deposit_ids, q.batch_id)),
       CASE WHEN list_has_any(g.taken, list_append(q.deposit_ids, q.batch_id)) THEN g.taken ELSE list_concat(g.taken, list_append(q.deposit_ids, q.batch_id)) END
FROM {p}greedy g JOIN {p}pairs q ON q.account_id = g.account_id AND q.rk = g.rk + 1""",
    )
    cte(f"{p}won", f"SELECT account_id, batch_id, key FROM {p}greedy WHERE won")

for p in ("", "o", "r"):
    cte(
        f"{p}others",
        f"SELECT w.batch_id, max(c.score) AS best, count(*) AS n FROM {p}won w JOIN {p}cand c ON c.batch_id = w.batch_id AND c.key <> w.key GROUP BY w.batch_id",
    )
    cte(
        f"{p}settled0",
        f"""
SELECT c.*, coalesce(o.n, 0) AS others, greatest(coalesce(o.best, 0), 0) AS runner_up, coalesce(o.n, 0) > 0 AND c.score - greatest(coalesce(o.best, 0), 0) <= 10 AS contested
FROM {p}won w JOIN {p}cand c ON c.batch_id = w.batch_id AND c.key = w.key LEFT JOIN {p}others o ON o.batch_id = w.batch_id""",
    )
    cte(
        f"{p}settled",
        f"""
SELECT * EXCLUDE (earned, score), earned + CASE WHEN contested THEN 0 ELSE 10 END AS earned, score AS provisional_score,
       CASE WHEN contested THEN 'COMPETING_CANDIDATE' ELSE 'UNIQUE_CANDIDATE' END AS uniqueness_code,
       {score('earned + CASE WHEN contested THEN 0 ELSE 10 END', 'attainable')} AS score FROM {p}settled0""",
    )


def band(value: str, contested: str) -> str:
    return f"CASE WHEN {value} < 40 THEN 'UNMATCHED' WHEN {contested} THEN 'AMBIGUOUS' WHEN {value} >= 85 THEN 'CONFIRMED' WHEN {value} >= 60 THEN 'PROBABLE' ELSE 'AMBIGUOUS' END"


# a channel that states its deductions has nothing to derive and no second pass
for p in ("o", "r"):
    cte(
        f"{p}res",
        f"""
SELECT b.batch_id, b.account_id, b.batch_date, b.gross_cents, b.expected_net_cents, s.deposit_ids, coalesce(s.n_deposits, 0) AS n_deposits, s.observed_cents, coalesce(s.score, 0) AS score,
       CASE WHEN s.batch_id IS NULL THEN 'UNMATCHED' ELSE {band('s.score', 's.contested')} END AS status, 'mat_' || substr(sha256(b.batch_id || '|' || coalesce(s.key, 'none')), 1, 16) AS match_id
FROM {p}bat b LEFT JOIN {p}settled s USING (batch_id)""",
    )
cte("oclaimed", "SELECT account_id, unnest(deposit_ids) AS deposit_id FROM ores WHERE n_deposits > 0")
cte("lost", "SELECT b.* FROM bat b WHERE b.batch_id NOT IN (SELECT batch_id FROM won)")
cte(
    "first",
    """
SELECT c.*, row_number() OVER (PARTITION BY batch_id ORDER BY rule, first_date, key) AS rn, count(*) OVER (PARTITION BY batch_id) AS n FROM cand c""",
)
cte(
    "unmatched",
    f"""
SELECT l.batch_id, coalesce(f.n, 0) AS candidates, m.merged_deposit,
       CASE WHEN f.amount_code IN {FAILED} THEN f.amount_code END AS amount_code,
       CASE WHEN f.n IS NULL THEN 'DATE_OUT_OF_WINDOW' WHEN f.date_code IN {FAILED} THEN f.date_code END AS date_code,
       CASE WHEN f.descriptor_code IN {FAILED} THEN f.descriptor_code END AS descriptor_code,
       CASE WHEN f.identity_code IN {FAILED} THEN f.identity_code END AS identity_code,
       CASE WHEN m.batch_id IS NOT NULL THEN 'SETTLEMENT_MERGED' WHEN f.shape_code IN {FAILED} THEN f.shape_code END AS shape_code,
       CASE WHEN m.batch_id IS NOT NULL AND f.shape_code IN {FAILED} AND f.shape_code <> 'SETTLEMENT_MERGED' THEN f.shape_code END AS first_shape,
       CASE WHEN f.multiple_code IN {FAILED} THEN f.multiple_code END AS multiple_code
FROM lost l LEFT JOIN first f ON f.batch_id = l.batch_id AND f.rn = 1 LEFT JOIN merged m ON m.batch_id = l.batch_id""",
)


def derived(source: str, observed: str) -> str:
    """The split of gross − observed in truncated cents, with its checks."""
    return f"""
SELECT *, wh_ok AND gap >= 0 AND rest >= 0 AS explained, rest - vat AS fee, abs(vat - ((rest - vat) * 19) // 100) AS drift FROM (
  SELECT *, (((rest * 100) // 119) * 19) // 100 AS vat FROM (
    SELECT *, gap - wh AS rest, gross_cents > 0 AS wh_ok FROM (
      SELECT *, gross_cents - {observed} AS gap, (gross_cents * 15) // 1000 AS wh FROM {source})))"""


cte("matched0", "SELECT s.*, b.gross_cents, b.expected_net_cents, b.deductions_cents, b.batch_date, b.channel, b.n_charges, b.band_lo, b.band_hi FROM settled s JOIN bat b USING (batch_id)")
cte("matched1", derived("matched0", "observed_cents"))
cte(
    "matched",
    """
SELECT *, gap::DOUBLE / gross_cents::DOUBLE AS rate, CASE WHEN explained THEN gap END AS derived_total, explained AND drift <= greatest(1, n_charges * 3) AS consistent FROM matched1""",
)
cte(
    "fp",
    f"""
SELECT b.batch_id, b.account_id, b.channel, b.bank_account_id, b.batch_date, b.gross_cents, b.expected_net_cents, b.n_charges, m.batch_id IS NOT NULL AS is_matched, m.key, m.deposit_ids,
       coalesce(m.n_deposits, 0) AS n_deposits, m.observed_cents, coalesce(m.score, 0) AS score, m.earned, coalesce(m.attainable, 135) AS attainable, coalesce(m.contested, false) AS contested,
       CASE WHEN m.batch_id IS NULL THEN 'UNMATCHED' ELSE {band('m.score', 'm.contested')} END AS status, m.rate, m.derived_total, m.consistent, m.fee, m.vat, m.wh, m.uniqueness_code,
       CASE WHEN m.batch_id IS NULL THEN u.amount_code ELSE m.amount_code END AS amount_code, CASE WHEN m.batch_id IS NULL THEN u.date_code ELSE m.date_code END AS date_code,
       CASE WHEN m.batch_id IS NULL THEN u.descriptor_code ELSE m.descriptor_code END AS descriptor_code, CASE WHEN m.batch_id IS NULL THEN u.identity_code ELSE m.identity_code END AS identity_code,
       CASE WHEN m.batch_id IS NULL THEN u.shape_code ELSE m.shape_code END AS shape_code, u.first_shape, CASE WHEN m.batch_id IS NULL THEN u.multiple_code ELSE m.multiple_code END AS multiple_code,
       'mat_' || substr(sha256(b.batch_id || '|' || coalesce(m.key, 'none')), 1, 16) AS match_id
FROM bat b LEFT JOIN matched m USING (batch_id) LEFT JOIN unmatched u USING (batch_id)""",
)
cte(
    "calib",
    """
SELECT account_id, n AS settlements, med AS median, dev AS deviation, floor((med - dev) * 10000 + 0.5) / 10000 AS typical_lo, floor((med + dev) * 10000 + 0.5) / 10000 AS typical_hi
FROM (SELECT account_id, count(*) AS n, median(rate) AS med, stddev_pop(rate) AS dev FROM fp WHERE derived_total IS NOT NULL GROUP BY account_id) WHERE n >= 3""",
)
cte(
    "res0",
    """
SELECT f.* EXCLUDE (amount_code, status, score), f.status AS first_pass_status, f.score AS first_score,
       coalesce(f.derived_total IS NOT NULL AND f.rate BETWEEN c.typical_lo AND c.typical_hi, false) AS typical, f.amount_code AS first_amount
FROM fp f LEFT JOIN calib c USING (account_id)""",
)
cte(
    "res1",
    f"""
SELECT *, CASE WHEN typical AND first_amount = 'IMPLIED_FEE_IN_BAND' THEN 'IMPLIED_FEE_TYPICAL' ELSE first_amount END AS amount_code,
       CASE WHEN typical AND first_amount = 'IMPLIED_FEE_IN_BAND' THEN {score('earned + 15', 'attainable')} ELSE first_score END AS score FROM res0""",
)
cte(
    "res",
    f"""SELECT *, CASE WHEN typical THEN {band('score', "first_pass_status = 'AMBIGUOUS'")} ELSE first_pass_status END AS status FROM res1""",
)
cte("claimed", "SELECT account_id, unnest(deposit_ids) AS deposit_id FROM res WHERE is_matched")
cte(
    "unattr",
    """
SELECT b.account_id, c.deposit_id AS movement_id, c.value_date, c.cents AS amount_cents, c.owner, b.channel,
       CASE WHEN c.owner = b.channel THEN 'AMOUNT_MISMATCH' ELSE 'DESCRIPTOR_FOREIGN' END AS reason
FROM cred c JOIN (SELECT DISTINCT account_id, bank_account_id, channel FROM bat) b USING (bank_account_id)
WHERE NOT EXISTS (SELECT 1 FROM claimed k WHERE k.account_id = b.account_id AND k.deposit_id = c.deposit_id)""",
)
TOTALS = """
SELECT {keys}, count(*) AS batches, count(*) FILTER (status = 'CONFIRMED') AS confirmed, count(*) FILTER (status = 'PROBABLE') AS probable, count(*) FILTER (status = 'AMBIGUOUS') AS ambiguous,
       count(*) FILTER (status = 'UNMATCHED') AS unmatched, CAST(sum(gross_cents) AS BIGINT) AS gross_cents, CAST(coalesce(sum(derived_total), 0) AS BIGINT) AS deductions_cents,
       coalesce(sum(derived_total), 0) <> 0 AS deductions_derived, CAST(sum(gross_cents) - coalesce(sum(derived_total), 0) AS BIGINT) AS expected_cents,
       CAST(coalesce(sum(observed_cents), 0) AS BIGINT) AS observed_cents, CAST(sum(gross_cents) - coalesce(sum(derived_total), 0) - coalesce(sum(observed_cents), 0) AS BIGINT) AS unexplained_cents
FROM res GROUP BY {keys}"""
cte("totals", TOTALS.format(keys="account_id"))
cte(
    "alts",
    """
SELECT c.batch_id, c.key, c.deposit_ids, c.score, coalesce(c.first_failed, CASE WHEN f.contested THEN 'COMPETING_CANDIDATE' ELSE 'AMOUNT_MISMATCH' END) AS rejected_because
FROM cand c JOIN fp f USING (batch_id) WHERE f.key IS NULL OR c.key <> f.key""",
)
cte("members", "SELECT b.batch_id, d.account_id, d.id AS movement_id, d.value_date, d.amount_cents FROM due d JOIN bat b ON b.account_id = d.account_id AND b.due_date = d.due_date")
cte(
    "shared0",
    """
SELECT m.*, coalesce(r.observed_cents, r.expected_net_cents) AS settled_cents, r.match_id, r.gross_cents, r.batch_date, r.deposit_ids, r.is_matched,
       CAST(coalesce(r.observed_cents, r.expected_net_cents) AS HUGEINT) * m.amount_cents AS p, sum(m.amount_cents) OVER (PARTITION BY m.batch_id) AS total
FROM members m JOIN res r USING (batch_id)""",
)
cte(
    "shared1",
    """
SELECT *, p // total AS units, row_number() OVER (PARTITION BY batch_id ORDER BY p % total DESC, movement_id) AS rk, settled_cents - sum(p // total) OVER (PARTITION BY batch_id) AS leftover FROM shared0""",
)
cte("shared", "SELECT *, CAST(units + CASE WHEN rk <= leftover THEN 1 ELSE 0 END AS BIGINT) AS attributed_cents FROM shared1")


def share(total: str, out: str, source: str, order: str) -> str:
    return f"""
SELECT * EXCLUDE (units, rk, leftover), CAST(units + CASE WHEN rk <= leftover THEN 1 ELSE 0 END AS BIGINT) AS {out} FROM (
  SELECT *, (CAST({total} AS HUGEINT) * amount_cents) // w AS units, row_number() OVER (PARTITION BY batch_id ORDER BY (CAST({total} AS HUGEINT) * amount_cents) % w DESC, {order}) AS rk,
         {total} - sum((CAST({total} AS HUGEINT) * amount_cents) // w) OVER (PARTITION BY batch_id) AS leftover FROM {source})"""


cte("ds0", "SELECT m.*, r.fee, r.vat, r.wh, sum(m.amount_cents) OVER (PARTITION BY m.batch_id) AS w FROM members m JOIN res r USING (batch_id) WHERE r.derived_total IS NOT NULL AND r.consistent")
cte("ds1", share("fee", "fee_cents", "ds0", "value_date, movement_id"))
cte("ds2", share("vat", "tax_cents", "ds1", "value_date, movement_id"))
cte("dshares", share("wh", "withholding_cents", "ds2", "value_date, movement_id"))
cte("dd0", "SELECT * EXCLUDE (gap) FROM elig")
cte("dd", derived("dd0", "cents"))
cte(
    "evlist",
    """
SELECT batch_id, list_filter([CASE WHEN NOT is_matched AND shape_code = 'SETTLEMENT_MERGED' THEN shape_code END, amount_code, date_code, descriptor_code, identity_code,
       CASE WHEN is_matched OR shape_code <> 'SETTLEMENT_MERGED' THEN shape_code END, first_shape, multiple_code, uniqueness_code,
       CASE WHEN derived_total IS NOT NULL THEN 'DEDUCTIONS_DERIVED' END], lambda x: x IS NOT NULL) AS codes, consistent FROM res""",
)
cte("evid", "SELECT batch_id, consistent, unnest(codes) AS code, generate_subscripts(codes, 1) - 1 AS position FROM evlist")
DIMENSION = """CASE WHEN code IN ('AMOUNT_EXACT', 'AMOUNT_WITHIN_ROUNDING', 'IMPLIED_FEE_TYPICAL', 'IMPLIED_FEE_IN_BAND', 'AMOUNT_MISMATCH', 'SUBSET_SUM_MULTIPLE', 'DEDUCTIONS_DERIVED') THEN 'AMOUNT'
    WHEN code IN ('DATE_T1_EXACT', 'DATE_IN_WINDOW', 'DATE_OUT_OF_WINDOW') THEN 'DATE' WHEN code IN ('DESCRIPTOR_MATCH', 'DESCRIPTOR_FOREIGN') THEN 'DESCRIPTOR'
    WHEN code IN ('UNIQUE_CANDIDATE', 'COMPETING_CANDIDATE') THEN 'UNIQUENESS' ELSE 'INTEGRITY' END"""
VOCABULARY = """(VALUES ('AMOUNT_EXACT', 'AMOUNT'), ('AMOUNT_WITHIN_ROUNDING', 'AMOUNT'), ('IMPLIED_FEE_TYPICAL', 'AMOUNT'), ('IMPLIED_FEE_IN_BAND', 'AMOUNT'), ('AMOUNT_MISMATCH', 'AMOUNT'),
    ('DATE_T1_EXACT', 'DATE'), ('DATE_IN_WINDOW', 'DATE'), ('DATE_OUT_OF_WINDOW', 'DATE'), ('DESCRIPTOR_MATCH', 'DESCRIPTOR'), ('DESCRIPTOR_FOREIGN', 'DESCRIPTOR'),
    ('UNIQUE_CANDIDATE', 'UNIQUENESS'), ('COMPETING_CANDIDATE', 'UNIQUENESS'), ('IDENTITY_HOLDS', 'INTEGRITY'), ('IDENTITY_BROKEN', 'INTEGRITY'), ('SETTLEMENT_SINGLE_CREDIT', 'INTEGRITY'),
    ('SETTLEMENT_SPLIT', 'INTEGRITY'), ('SETTLEMENT_MERGED', 'INTEGRITY'), ('SUBSET_SUM_UNIQUE', 'AMOUNT'), ('SUBSET_SUM_MULTIPLE', 'AMOUNT'), ('UNRESOLVED_COMBINATORIAL', 'AMOUNT'),
    ('MATCHED_BY_REF', 'ERP'), ('MATCHED_EXACT', 'ERP'), ('MATCHED_AGGREGATED', 'ERP'), ('INCOMPLETE_ENTRY', 'ERP'), ('DATE_SHIFT', 'ERP'), ('AMOUNT_MISMATCH_ERP', 'ERP'), ('MISSING_IN_ERP', 'ERP'),
    ('MISSING_IN_LEDGER', 'ERP'), ('DUPLICATE_IN_ERP', 'ERP'), ('NO_ACCOUNT_MAPPING', 'ERP'), ('NO_CONTRA_ACCOUNT', 'ERP'), ('BALANCE_CHAIN_OK', 'INGESTION'), ('BALANCE_CHAIN_BROKEN', 'INGESTION'),
    ('SUMMARY_TOTALS_OK', 'INGESTION'), ('SUMMARY_TOTALS_MISMATCH', 'INGESTION'), ('TRANSACTION_EXCLUDED_NOT_APPROVED', 'INGESTION'), ('DESCRIPTOR_UNCLASSIFIED', 'INGESTION'), ('SOURCE_STALE', 'INGESTION'),
    ('DEDUCTIONS_DERIVED', 'AMOUNT')) v(code, dimension)"""
cte("uses", f"SELECT v.code, v.dimension, count(e.batch_id) AS results FROM {VOCABULARY} LEFT JOIN evid e USING (code) GROUP BY 1, 2")
TEXTS = ", ".join(f"coalesce({c}, '') AS {c}" for c in CODES)
TEXTS_SQL = TEXTS
D = "CAST({0} AS VARCHAR) AS {0}".format


def code_query(p: str, code: str) -> str:
    return f"SELECT batch_id, key, coalesce({code}, '') AS {code} FROM {p}cand WHERE n_deposits > 0"


STAMPS = " UNION ALL ".join(f"SELECT batch_id, key, {c} AS code FROM cand WHERE {c} IS NOT NULL" for c in CODES)

#: The order flow's charges with their shares of what landed, or of the expected net where nothing did.
cte(
    "oshares",
    """
SELECT *, CAST(CASE WHEN t < 0 THEN -1 ELSE 1 END * (units + CASE WHEN rk <= abs(t) - su THEN 1 ELSE 0 END) AS BIGINT) AS attributed_cents FROM (
        SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY r DESC, movement_id) AS rk, sum(units) OVER (PARTITION BY batch_id) AS su FROM (
          SELECT *, (CAST(abs(t) AS HUGEINT) * w) // tw AS units, (CAST(abs(t) AS HUGEINT) * w) % tw AS r FROM (
            SELECT b.batch_id, d.id AS movement_id, d.amount_cents AS w, coalesce(x.observed_cents, b.expected_net_cents) AS t, sum(d.amount_cents) OVER (PARTITION BY b.batch_id) AS tw,
              b.gross_cents, coalesce(x.n_deposits, 0) > 0 AS is_matched, x.deposit_ids
            FROM odue d JOIN obat b ON b.account_id = d.account_id AND b.due_date = d.due_date LEFT JOIN ores x ON x.batch_id = b.batch_id WHERE d.type = 'CHARGE')))""",
    kept=True,
)

def multiset(content: str) -> str:
    """A digest over a count and eight sums of 32-bit parts of SHA-256."""
    sums = [f"CAST(coalesce(sum(CAST('0x' || substr(sha256({content}), {8 * n + 1}, 8) AS BIGINT)), 0) AS VARCHAR)" for n in range(8)]
    return f"sha256(concat_ws('|', CAST(count({content}) AS VARCHAR), {', '.join(sums)}))"


ORACLE = {
    "settlements": f"""SELECT match_id, account_id, channel, {D('batch_date')}, status, CASE WHEN n_deposits > 1 THEN 'SPLIT_SETTLEMENT' ELSE 'SCHEDULED_SETTLEMENT' END AS rule_id, score, gross_cents,
        expected_net_cents, coalesce(observed_cents, 0) AS observed_cents, coalesce(derived_total, 0) AS derived_total, coalesce(amount_code, '') AS amount_code, coalesce(date_code, '') AS date_code,
        coalesce(shape_code, '') AS shape_code FROM res""",
    "settlements_stated": f"""SELECT match_id, account_id, {D('batch_date')}, status, CASE WHEN n_deposits > 1 THEN 'SPLIT_SETTLEMENT' ELSE 'SCHEDULED_SETTLEMENT' END AS rule_id, score, gross_cents,
        expected_net_cents, coalesce(observed_cents, 0) AS observed_cents FROM ores""",
    "asg_greedy_stated": "SELECT batch_id, key FROM owon",
    "out_unattributed_stated": f"""SELECT account_id, deposit_id AS movement_id, {D('value_date')}, cents AS amount_cents, CASE WHEN owner = 'delta' THEN 'AMOUNT_MISMATCH' ELSE 'DESCRIPTOR_FOREIGN' END AS reason
        FROM ocred c WHERE NOT EXISTS (SELECT 1 FROM oclaimed k WHERE k.account_id = c.account_id AND k.deposit_id = c.deposit_id)""",
    "out_totals_stated": """SELECT account_id, count(*) AS batches, count(*) FILTER (status = 'CONFIRMED') AS confirmed, count(*) FILTER (status = 'PROBABLE') AS probable, count(*) FILTER (status = 'AMBIGUOUS') AS ambiguous,
        count(*) FILTER (status = 'UNMATCHED') AS unmatched, CAST(sum(gross_cents) AS BIGINT) AS gross_cents, CAST(sum(gross_cents - expected_net_cents) AS BIGINT) AS deductions_cents, false AS deductions_derived,
        CAST(sum(expected_net_cents) AS BIGINT) AS expected_cents, CAST(coalesce(sum(observed_cents), 0) AS BIGINT) AS observed_cents, CAST(sum(expected_net_cents) - coalesce(sum(observed_cents), 0) AS BIGINT) AS unexplained_cents
        FROM ores GROUP BY account_id""",
    "scheduled_only": """SELECT b.batch_id, b.gross_cents, b.expected_net_cents, coalesce(s.key, '') AS deposit_id, coalesce(s.score, 0) AS score FROM obat b LEFT JOIN
        (SELECT batch_id, key, score, row_number() OVER (PARTITION BY batch_id ORDER BY score DESC, key) AS rn FROM ocand WHERE rule = 1 AND gate IS NULL) s ON s.batch_id = b.batch_id AND s.rn = 1""",
    "bat_build": f"SELECT batch_id, account_id, channel, {D('due_date')}, {D('batch_date')}, n_charges, gross_cents FROM bat",
    "bat_gross": f"SELECT batch_id, account_id, {D('due_date')}, {D('batch_date')}, n_charges, gross_cents FROM obat",
    "bat_members": "SELECT b.batch_id, d.id AS movement_id, d.type FROM odue d JOIN obat b ON b.account_id = d.account_id AND b.due_date = d.due_date",
    "bat_deductions": """SELECT batch_id, 'FEE' AS kind, fee_cents AS amount_cents, 'EXPLICIT' AS basis FROM obat UNION ALL SELECT batch_id, 'TAX', tax_cents, 'EXPLICIT' FROM obat
        UNION ALL SELECT batch_id, 'WITHHOLDING', withholding_cents, 'EXPLICIT' FROM obat""",
    "bat_net": "SELECT batch_id, deductions_cents, expected_net_cents FROM obat",
    "bat_identity": "SELECT batch_id, abs(expected_net_cents + deductions_cents - gross_cents) <= 1 AS holds FROM obat",
    "bat_list": f"""SELECT batch_id, {D('batch_date')}, account_id, gross_cents, (SELECT count(*) FROM obat WHERE batch_date BETWEEN '1997-01-01' AND '1997-06-30') AS total FROM
        (SELECT * FROM obat WHERE batch_date BETWEEN '1997-01-01' AND '1997-06-30' ORDER BY batch_date, account_id LIMIT 50 OFFSET 100)""",
    "bat_find": "SELECT batch_id, gross_cents, n_charges FROM bat WHERE account_id = 'gw:0' AND batch_date = '2024-01-10'",
    "cand_bank_range": f"SELECT deposit_id AS id, bank_account_id AS account_id, {D('value_date')}, cents AS amount_cents FROM cred WHERE value_date BETWEEN '2024-01-10' AND '2024-01-24'",
    "cand_eligible": f"SELECT batch_id, deposit_id, {D('value_date')}, cents, names_channel FROM elig",
    "cand_eligible_stated": f"SELECT batch_id, deposit_id, {D('value_date')}, cents, names_channel FROM oelig",
    "cand_target": "SELECT batch_id, target_cents, slack_cents FROM target",
    "cand_target_stated": "SELECT batch_id, target_cents, slack_cents FROM otarget",
    "cand_single": f"SELECT batch_id, key, observed_cents, {TEXTS} FROM single",
    "cand_single_stated": f"SELECT batch_id, key, observed_cents, {TEXTS} FROM osingle",
    "cand_subset": "SELECT batch_id, solution, len(path) AS size, list_aggregate(list_sort(deposits), 'string_agg', '+') AS key, true AS complete FROM sol",
    "cand_subset_stated": "SELECT batch_id, solution, len(path) AS size, list_aggregate(list_sort(deposits), 'string_agg', '+') AS key, true AS complete FROM osol",
    "cand_split": f"SELECT batch_id, key, n_deposits, observed_cents, solutions, {TEXTS} FROM split",
    "cand_split_stated": f"SELECT batch_id, key, n_deposits, observed_cents, solutions, {TEXTS} FROM osplit",
    "cand_merged": f"SELECT batch_id, {D('merged_with')}, merged_deposit, round(merged_rate, 6) AS merged_rate FROM merged",
    "cand_merged_stated": f"SELECT batch_id, {D('merged_with')}, merged_deposit, round(merged_rate, 6) AS merged_rate FROM omerged",
    "cand_dedupe": "SELECT batch_id, key, rule, n_deposits FROM cand WHERE n_deposits > 0",
    "amt_describe": """SELECT batch_id, deposit_id AS key, gross_cents, deductions_cents, expected_net_cents, cents AS observed_cents, cents - expected_net_cents AS delta_cents,
        round((gross_cents - cents)::DOUBLE / gross_cents::DOUBLE, 6) AS implied_rate FROM elig""",
    "ev_amount": code_query("", "amount_code"),
    "ev_amount_stated": code_query("o", "amount_code"),
    "ev_date": code_query("o", "date_code"),
    "ev_descriptor": code_query("", "descriptor_code"),
    "ev_identity": code_query("", "identity_code") + " UNION ALL " + code_query("o", "identity_code"),
    "sc_score": "SELECT batch_id, key, rule, earned, attainable, score FROM cand",
    "sc_score_stated": "SELECT batch_id, key, rule, earned, attainable, score FROM ocand",
    "sc_attainable": "SELECT account_id, 125 AS attainable, count(*) AS batches FROM bat GROUP BY 1 UNION ALL SELECT account_id, 135, count(*) FROM obat GROUP BY 1",
    "sc_gate": "SELECT batch_id, key, coalesce(gate, '') AS gate, coalesce(first_failed, '') AS first_failed FROM ocand",
    "sc_stamp": f"SELECT batch_id, key, code, {weight('code')} AS weight FROM ({STAMPS})",
    "sc_band": "SELECT batch_id, score, contested, status FROM fp",
    "rubric": f"SELECT code, dimension, {weight('code')} AS weight, code IN {GATES} AS disqualifying, 135 AS attainable, results FROM uses",
    "rubric_glossary": f"SELECT dimension, code, {weight('code')} AS weight, results FROM uses",
    "asg_pairs": "SELECT batch_id, key, score, n_deposits FROM pairs",
    "asg_pairs_stated": "SELECT batch_id, key, score, n_deposits FROM opairs",
    "asg_greedy": "SELECT batch_id, key FROM won",
    "asg_contest": "SELECT batch_id, others, runner_up, provisional_score, contested, uniqueness_code FROM settled",
    "asg_final": f"SELECT batch_id, earned, attainable, score, {band('score', 'contested')} AS status FROM settled",
    "asg_reject": "SELECT batch_id, key, score, rejected_because FROM alts",
    "asg_unmatched": f"SELECT batch_id, candidates, {TEXTS}, coalesce(first_shape, '') AS first_shape, coalesce(merged_deposit, '') AS merged_deposit FROM unmatched",
    "asg_invariants": "SELECT DISTINCT account_id, 0 AS credits_twice, 0 AS batches_twice, 0 AS pairs_left FROM obat",
    "res_match": f"""SELECT f.match_id, f.batch_id, {D('batch_date')}, f.status, coalesce(list_aggregate(list_sort(f.deposit_ids), 'string_agg', '+'), '') AS right, f.gross_cents, f.expected_net_cents,
        coalesce(f.observed_cents, 0) AS observed_cents, coalesce(f.observed_cents - f.expected_net_cents, 0) AS delta_cents, CAST(h.n1 AS VARCHAR) AS window_start, CAST(h.n3 AS VARCHAR) AS window_end, f.score
        FROM fp f JOIN ahead h ON h.d = f.batch_date""",
    "res_rule": "SELECT batch_id, CASE WHEN n_deposits > 1 THEN 'SPLIT_SETTLEMENT' ELSE 'SCHEDULED_SETTLEMENT' END AS rule_id, CASE WHEN n_deposits > 1 THEN 1 ELSE 2 END AS rule_version FROM res",
    "ded_derive": """SELECT batch_id, deposit_id AS key, gap AS gap_cents, CASE WHEN explained THEN fee ELSE 0 END AS fee, CASE WHEN explained THEN vat ELSE 0 END AS tax, CASE WHEN explained THEN wh ELSE 0 END AS withholding,
        CASE WHEN explained THEN drift ELSE -1 END AS vat_drift, round(gap::DOUBLE / gross_cents::DOUBLE, 6) AS implied_rate, explained AND drift <= greatest(1, n_charges * 3) AS consistent,
        gap::DOUBLE / gross_cents::DOUBLE BETWEEN band_lo AND band_hi AS in_band FROM dd""",
    "ded_apply": "SELECT batch_id, fee AS derived_fee, vat AS derived_tax, wh AS derived_withholding, derived_total, consistent AS derived_consistent FROM fp WHERE derived_total IS NOT NULL",
    "cal_rates": "SELECT account_id, settlements, round(median, 6) AS median, round(deviation, 6) AS deviation, round(typical_lo, 6) AS typical_lo, round(typical_hi, 6) AS typical_hi FROM calib",
    "cal_typical": "SELECT batch_id, coalesce(amount_code, '') AS amount_code, score, status, first_pass_status FROM res",
    "out_unattributed": f"SELECT account_id, movement_id, {D('value_date')}, amount_cents, reason FROM unattr",
    "out_unattributed_anywhere": "SELECT deposit_id AS id, cents AS amount_cents FROM cred WHERE deposit_id NOT IN (SELECT deposit_id FROM claimed)",
    "out_totals": "SELECT * FROM totals",
    "out_summary": """SELECT t.*, coalesce(u.c, 0) AS unattributed_channel, coalesce(u.s, 0) AS unattributed_channel_cents, coalesce(u.o, 0) AS unattributed_other FROM totals t LEFT JOIN
        (SELECT account_id, count(*) FILTER (reason = 'AMOUNT_MISMATCH') AS c, CAST(coalesce(sum(amount_cents) FILTER (reason = 'AMOUNT_MISMATCH'), 0) AS BIGINT) AS s,
                count(*) FILTER (reason <> 'AMOUNT_MISMATCH') AS o FROM unattr GROUP BY 1) u USING (account_id)""",
    "out_list": f"""SELECT match_id, {D('batch_date')}, account_id, score, (SELECT count(*) FROM res WHERE status = 'AMBIGUOUS' AND batch_date BETWEEN '2024-01-08' AND '2024-01-20') AS total FROM
        (SELECT * FROM res WHERE status = 'AMBIGUOUS' AND batch_date BETWEEN '2024-01-08' AND '2024-01-20' ORDER BY batch_date, account_id LIMIT 10 OFFSET 2)""",
    "out_find": "SELECT match_id, batch_id, status, score FROM res WHERE match_id = (SELECT min(match_id) FROM res)",
    "out_members": f"""SELECT r.match_id, 'CHARGE' AS role, m.movement_id, {D('value_date')}, m.amount_cents, 0 AS score, '' AS reason FROM members m JOIN res r USING (batch_id)
        UNION ALL SELECT r.match_id, 'CREDIT', c.deposit_id, CAST(c.value_date AS VARCHAR), c.cents, 0, '' FROM (SELECT match_id, unnest(deposit_ids) AS deposit_id FROM res) r JOIN cred c USING (deposit_id)
        UNION ALL SELECT r.match_id, 'REJECTED', c.deposit_id, CAST(c.value_date AS VARCHAR), c.cents, a.score, a.rejected_because FROM (SELECT batch_id, score, rejected_because, unnest(deposit_ids) AS deposit_id FROM alts) a
          JOIN res r USING (batch_id) JOIN cred c USING (deposit_id)""",
    "out_member_sums": """SELECT match_id, gross_cents AS charges_cents, coalesce(observed_cents, 0) AS credits_cents FROM res""",
    "out_unattr_list": f"""SELECT 'alpha' AS wanted, movement_id, {D('value_date')}, amount_cents, owner FROM unattr WHERE owner = 'alpha'
        UNION ALL SELECT 'other', movement_id, CAST(value_date AS VARCHAR), amount_cents, '' FROM unattr WHERE owner IS NULL""",
    "out_channels": """SELECT r.account_id, r.channel, count(*) FILTER (is_matched) AS settlements, count(derived_total) AS observed_count,
        round(coalesce(min(rate) FILTER (derived_total IS NOT NULL), -1), 6) AS lowest_rate, round(coalesce(max(rate) FILTER (derived_total IS NOT NULL), -1), 6) AS highest_rate,
        CASE r.channel WHEN 'alpha' THEN 'corte diario' WHEN 'beta' THEN 'corte semanal (cierra domingo)' ELSE 'corte mensual (cierra el día 31)' END AS cadence,
        CASE r.channel WHEN 'alpha' THEN '21:00 America/Bogota' ELSE '' END AS cutoff, r.channel <> 'gamma' AS declares_own_band,
        count(*) FILTER (is_matched) > 0 AND count(derived_total) = 0 AS reports_own_deductions, round(coalesce(any_value(c.typical_lo), -1), 6) AS typical_lo, round(coalesce(any_value(c.typical_hi), -1), 6) AS typical_hi
        FROM res r LEFT JOIN calib c USING (account_id) GROUP BY r.account_id, r.channel""",
    "out_exceptions": "SELECT match_id, status, abs(coalesce(observed_cents - expected_net_cents, expected_net_cents)) AS at_risk_cents FROM res WHERE status <> 'CONFIRMED'",
    "out_agent_summary": "SELECT * FROM (" + TOTALS.format(keys="run").replace("FROM res", "FROM (SELECT *, 'latest' AS run FROM res)") + ")",
    "out_agent_list": """SELECT * FROM (SELECT 'unmatched' AS asked, match_id AS id, status, abs(coalesce(observed_cents - expected_net_cents, expected_net_cents)) AS cents,
          (SELECT count(*) FROM res WHERE status = 'UNMATCHED') AS total FROM res WHERE status = 'UNMATCHED' ORDER BY batch_date, account_id LIMIT 20)
        UNION ALL SELECT * FROM (SELECT 'all', match_id, status, abs(coalesce(observed_cents - expected_net_cents, expected_net_cents)), (SELECT count(*) FROM res) FROM res
          ORDER BY batch_date, account_id LIMIT 10 OFFSET 30)
        UNION ALL SELECT * FROM (SELECT 'unattributed', movement_id, '', amount_cents, 0 FROM unattr ORDER BY value_date, movement_id LIMIT 15)""",
    "out_evidence": f"""SELECT batch_id, position, code, {DIMENSION} AS dimension, CASE WHEN code = 'DEDUCTIONS_DERIVED' THEN consistent ELSE code NOT IN {FAILED} END AS passed, {weight('code')} AS weight FROM evid""",
    "out_rates_shown": "SELECT batch_id, replace(printf('%.2f', round(rate, 6) * 100), '.', ',') || '%' AS rate FROM res WHERE is_matched",
    "snk_report": "SELECT 'run_20240301000000' AS run_id, account_id, batches, gross_cents, observed_cents FROM totals",
    "snk_revive": f"SELECT account_id AS scope, match_id, {D('batch_date')}, gross_cents FROM res WHERE batch_date >= '2024-01-10'",
    "snk_run_report": f"""SELECT 'run' AS section, CAST(min(batch_date) AS VARCHAR) AS id, 0 AS figure, '' AS what FROM bat
        UNION ALL SELECT 'summary', account_id, gross_cents, '' FROM totals UNION ALL SELECT 'reconciliations', match_id, gross_cents, status FROM res
        UNION ALL SELECT 'unattributed', movement_id, amount_cents, reason FROM unattr
        UNION ALL SELECT 'erp', journal_key, CAST(sum(entry_cents) AS BIGINT), '' FROM erp_entries GROUP BY journal_key
        UNION ALL SELECT 'rubric', code, {weight('code')}, dimension FROM {VOCABULARY}""",
    "run_flow": f"""SELECT match_id, account_id, {D('batch_date')}, status, score, gross_cents, expected_net_cents, coalesce(observed_cents, 0) AS observed_cents FROM rres""",
    "run_loads": """SELECT 'orders' AS source, count(*) AS inserted, 0 AS updated, 1 AS version FROM omov UNION ALL SELECT 'bank', count(*), 0, 2 FROM ocred
        UNION ALL SELECT 'orders again', 0, count(*), 2 FROM omov""",
    "snk_run_record": f"""SELECT 'run_20240201000000' AS run_id, '2024-01-01' AS range_from, '2024-01-31' AS range_to, 'v1' AS ruleset_version, source, digest, true AS finished FROM (
        SELECT 'pages' AS source, {multiset('html')} AS digest FROM pages UNION ALL SELECT 'documents', {multiset("concat_ws('|', doc_id, text)")} FROM documents)""",
    "alloc_largest": """SELECT l_orderkey, l_linenumber, CAST(sign * (units + CASE WHEN rk <= t - su THEN 1 ELSE 0 END) AS BIGINT) AS share_cents FROM (
        SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY r DESC, l_linenumber) AS rk, sum(units) OVER (PARTITION BY l_orderkey) AS su FROM (
          SELECT *, (CAST(t AS HUGEINT) * w) // tw AS units, (CAST(t AS HUGEINT) * w) % tw AS r FROM (
            SELECT l.*, o.c AS t, CASE WHEN o.o_orderstatus = 'P' THEN -1 ELSE 1 END AS sign, sum(w) OVER (PARTITION BY l_orderkey) AS tw FROM
              (SELECT l_orderkey, l_linenumber, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS w FROM lineitem GROUP BY 1, 2) l JOIN ocents o ON o.o_orderkey = l.l_orderkey)))""",
    "lin_attribute": "SELECT movement_id, batch_id, amount_cents, settled_cents, attributed_cents FROM shared",
    "lin_attribute_stated": "SELECT movement_id, batch_id, attributed_cents FROM oshares",
    "lin_trace": """SELECT s.movement_id, s.batch_id, s.match_id, coalesce(c.deposit_id, '') AS bank_credit_id, c.deposit_id IS NOT NULL AS settled, s.attributed_cents,
        'CHARGE=' || s.amount_cents || ';BATCH=' || s.gross_cents || ';SETTLEMENT=' || s.settled_cents || CASE WHEN c.deposit_id IS NOT NULL THEN ';BANK_CREDIT=' || c.cents ELSE '' END AS steps
        FROM shared s LEFT JOIN cred c ON c.deposit_id = s.deposit_ids[1]""",
    "lin_correlate": """SELECT charge_id, credit_id, CASE WHEN NOT is_matched THEN 'UNSETTLED' WHEN inside THEN 'SETTLED_IN' ELSE 'SETTLED_ELSEWHERE' END AS verdict,
        CASE WHEN inside THEN attributed_cents ELSE 0 END AS attributed_cents, CASE WHEN inside THEN round(amount_cents::DOUBLE / gross_cents::DOUBLE, 6) ELSE -1 END AS share_of_batch
        FROM (SELECT p.*, is_matched AND list_contains(deposit_ids, credit_id) AS inside FROM (
          SELECT DISTINCT s.movement_id AS charge_id, unnest(list_distinct(list_append(CASE WHEN s.is_matched THEN s.deposit_ids ELSE [] END, f.credit_id))) AS credit_id,
            s.is_matched, s.deposit_ids, s.attributed_cents, s.amount_cents, s.gross_cents
          FROM shared s JOIN (SELECT DISTINCT account_id, bank_account_id FROM bat) USING (account_id)
          JOIN (SELECT bank_account_id, min(deposit_id) AS credit_id FROM cred GROUP BY 1) f USING (bank_account_id)) p)
        UNION ALL SELECT id, 'none', 'UNRELATED', 0, -1 FROM omov WHERE type = 'CHARGE'""",
    "lin_attribute_orders": "SELECT movement_id, batch_id, t AS settled_cents, attributed_cents FROM oshares",
    "lin_correlate_orders": """SELECT charge_id, credit_id, CASE WHEN credit_id <> 'none' THEN 'SETTLED_IN' WHEN is_matched THEN 'SETTLED_ELSEWHERE' ELSE 'UNSETTLED' END AS verdict,
        CASE WHEN credit_id <> 'none' THEN cents ELSE 0 END AS attributed_cents, CASE WHEN credit_id <> 'none' THEN round(w::DOUBLE / gross_cents::DOUBLE, 6) ELSE -1 END AS share_of_batch
        FROM (SELECT movement_id AS charge_id, unnest(list_append(CASE WHEN is_matched THEN deposit_ids ELSE [] END, 'none')) AS credit_id, is_matched, attributed_cents AS cents, w, gross_cents FROM oshares)""",
    "ded_shares": "SELECT batch_id, movement_id, fee_cents, tax_cents, withholding_cents FROM dshares",
}
ORACLE = {name: sql(body) for name, body in ORACLE.items()}
